"""Join toolbox: keep-first de-duplication, validated many-to-one, as-of, semi and anti joins, key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.operators.asknown import as_known_join

MESSAGE_KEY = ("match_id", "time", "player_slot")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per key, the first by ``order`` (default: all other columns ascending, nulls last).

    Nulls in keys are values of their own.  The row is found by a map-side combined ``min_by`` on a struct, so a key with
    a third of all rows costs one partial row a task, where a window would sort them all in one.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    by = [F.col(o) if isinstance(o, str) else o for o in (order or rest)]
    rank = F.struct(*[x for i, o in enumerate(by) for x in (o.isNull().alias(f"n{i}"), o.alias(f"v{i}"))])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """Left join that can't multiply rows: ``right`` is reduced to one row a key, its columns win over the left's of the same name."""
    on = list(on)
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.drop(*clash).join(keep_first(right, on, order), on, "left")


def dictionary_join(left: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Look columns up by key; unknown keys and null values get the defaults."""
    cols = list(defaults)
    r = keep_first(table.select(key, *cols), [key])
    out = left.drop(*[c for c in cols if c in left.columns]).join(r, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def interval_ends(points: DataFrame, start: str, last: str = "2099-12-31 00:00:00", end: str = "date_end") -> DataFrame:
    """Close each interval one second before the next start; the last one at ``last``.  For dimensions (one sort)."""
    w = Window.orderBy(start)
    return points.withColumn(end, F.coalesce(F.lead(start).over(w) - F.expr("INTERVAL 1 SECOND"), F.lit(last).cast("timestamp_ntz")))


def asof_clip(left: DataFrame, points: DataFrame, time: str, start: str, value: str, out: str) -> DataFrame:
    """The value of the latest start <= time; times before the first start get the first; null stays null.

    Of equal starts the greatest value counts.  Points become closed intervals by one sort (a dimension), joined by period (see
    ``as_known_join``); ``left`` may be large.
    """
    line = points.where(F.col(start).isNotNull()).groupBy(F.col(start).alias("_s")).agg(F.max(value).alias("_v"))
    first = line.agg(F.min("_s"), F.min_by("_v", "_s")).first()
    closed = line.withColumn("_e", F.lead("_s").over(Window.orderBy("_s")))
    joined = as_known_join(left, closed, event_time=time, valid_from="_s", valid_to="_e", known_at=None, value="_v", out=out)
    return joined.withColumn(out, F.when(F.col(time) < F.lit(first[0]), F.lit(first[1])).otherwise(F.col(out)))


def anti_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def semi_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def leak_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys common to both (0: no leak)."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("n_common"))


def assert_no_inflation(before: DataFrame, after: DataFrame) -> None:
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"a join changed the number of rows from {n} to {m}")


def schema_difference(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns."""
    return sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted))
