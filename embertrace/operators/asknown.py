"""Attributes as known at event time: periodic as-known snapshots plus change logs.

A fact row is valid over ``[valid_from, valid_to)`` and known from ``known_at`` on
(null: from ``valid_from``).  It *applies* at a moment t when it is both known and valid,
that is from ``enters = greatest(known_at, valid_from)`` up to ``valid_to``.

Time is cut into periods.  Two tables are materialised in the shared folder:

* the *snapshots*: for every period in which events occur, the facts that apply at its first moment.  A fact is left out if
  another of the same snapshot goes before it and lasts as long, for it can't win at any later moment;
* the *change log*: the facts that enter within a period, each in the one period it enters.

An event is joined to the snapshot of its own period, the last one before it, and replays only the changes between that
snapshot and itself.  It never sees a fact that entered later.  Both joins are equi-joins on (keys, period).

The length of a period starts at ``period_days`` and is halved until no period's log has more than ``MOST_CHANGES`` changes (or a
period is an hour), which bounds the array that an event replays; the result doesn't depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.session import cut

MOST_CHANGES = 1000
HOUR = 3600
_BEST = ("_from", "_known", "_value")


def _micros(t):
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), t)  # of the wall clock, whatever the session's zone


def _period(t, length: int):
    size = F.lit(length * 1_000_000)
    return ((_micros(t) - F.pmod(_micros(t), size)) / size).cast("long")


def _start(length: int):
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(_period * {length} AS decimal(18, 6)))")


def period_length(facts: DataFrame, keys: Sequence[str], days: int, most: int = MOST_CHANGES) -> int:
    """Seconds of a period, so that no (keys, period) has more than ``most`` changes."""
    length = days * 24 * HOUR
    while length > HOUR:
        n = facts.groupBy(*keys, _period(F.col("_enters"), length).alias("_period")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if n is None or n <= most:
            break
        length = max(HOUR, length // 2)
    return length


def snapshots(facts: DataFrame, periods: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """keys, _period, _held: the facts (of ``_BEST``, _enters and _to) that apply at the first moment of each of ``periods`` (keys, _period)."""
    f = facts.withColumn("_first", _period(F.col("_enters"), length)).withColumn("_last", _period(F.col("_to"), length))
    if keys:
        x = f.join(periods, list(keys)).where("_period BETWEEN _first AND _last")
    else:  # one calendar of event periods for all facts
        calendar = [r["_period"] for r in periods.select("_period").distinct().orderBy("_period").collect()]
        x = f.withColumn("_period", F.explode(F.filter(F.lit(calendar).cast("array<bigint>"), lambda p: (p >= F.col("_first")) & (p <= F.col("_last"))))) if calendar else f.withColumn("_period", F.lit(0).cast("long")).where("false")
    x = x.where((F.col("_enters") <= _start(length)) & (F.col("_to") > _start(length)))
    before = Window.partitionBy(*keys, "_period").orderBy(*[F.desc(c) for c in _BEST]).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_longest", F.max("_to").over(before)).where("_longest IS NULL OR _longest < _to")
    return x.groupBy(*keys, "_period").agg(F.collect_list(F.struct(*_BEST, "_enters", "_to")).alias("_held"))


def change_log(facts: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """keys, _period, _changes: the facts that enter within each period, after its first moment."""
    inside = facts.withColumn("_period", _period(F.col("_enters"), length)).where(F.col("_enters") > _start(length))
    return inside.groupBy(*keys, "_period").agg(F.collect_list(F.struct(*_BEST, "_enters", "_to")).alias("_changes"))


def as_known_join(
    events: DataFrame,
    facts: DataFrame,
    *,
    event_time: str,
    valid_from: str,
    valid_to,
    known_at: str | None,
    value: str,
    out: str = "value",
    keys: Sequence[str] = (),
    period_days: int = 32,
    salts: int = 8,
) -> DataFrame:
    """``events`` plus column ``out``: the value of the applying fact with the latest ``valid_from``.

    valid_to: a column name or expression for the exclusive end of a fact.  keys: entity columns present on both sides.

    Defined cases: an event without time or with a null key gets null; no applying fact gives null; facts with null
    ``valid_from`` never apply; a null ``valid_to`` is open; exact duplicate facts count once; of facts with the
    same ``valid_from`` the one known last wins, then the greatest value.  Events keep all their rows (repeats too) and
    columns; if ``events`` already has a column ``out``, it is replaced.  Empty tables give empty or all-null results.

    Scale: ``events`` is read twice, once for its periods, so pass a table or a cut plan.  An event period is hot when all events
    are recent; ``salts`` copies of the (small) snapshots and logs spread it.
    """
    keys = list(keys)
    to = F.col(valid_to) if isinstance(valid_to, str) else valid_to
    end = F.coalesce(to, F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'"))
    f = facts.select(
        *keys,
        F.col(valid_from).cast("timestamp_ntz").alias("_from"),
        end.cast("timestamp_ntz").alias("_to"),
        F.coalesce(F.col(known_at), F.col(valid_from)).cast("timestamp_ntz").alias("_known") if known_at else F.col(valid_from).cast("timestamp_ntz").alias("_known"),
        F.col(value).alias("_value"),
    ).where("_from IS NOT NULL AND _value IS NOT NULL").distinct()
    f = cut(f.withColumn("_enters", F.greatest("_known", "_from")).where("_enters < _to"))
    length = period_length(f, keys, period_days)
    e = events.drop(out) if out in events.columns and out not in keys else events
    t = F.col(event_time).cast("timestamp_ntz")
    e = e.withColumn("_period", _period(t, length))
    periods = e.select(*keys, "_period").where("_period IS NOT NULL").distinct()
    held, changes = cut(snapshots(f, periods, keys, length)), cut(change_log(f, keys, length))
    spread = lambda d: d.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*keys, "_period", "_salt"]
    e = e.withColumn("_salt", F.pmod(F.xxhash64(t, *[F.col(c) for c in events.columns[:1]]), F.lit(salts)).cast("int"))
    joined = e.join(spread(held), on, "left").join(spread(changes), on, "left")
    still = F.filter("_held", lambda x: t < x["_to"])
    replayed = F.filter("_changes", lambda x: (x["_enters"] <= t) & (t < x["_to"]))
    best = F.greatest(F.array_max(still), F.array_max(replayed))  # greatest passes over nulls
    return joined.withColumn(out, best["_value"]).select(*e.columns[:-2], out)
