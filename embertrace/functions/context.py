"""Context columns: outcome, time, calendar, tier, phase, bins, scores, label sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE_B_FROM = 128
OTHER = "Lainnya"
NO_PHASE = "lainnya"


def outcome(player_slot: Column, radiant_win: Column) -> Column:
    """win, loss or unknown for the sender."""
    return F.when(player_slot.isNull() | radiant_win.isNull(), "unknown").when((player_slot < SIDE_B_FROM) == radiant_win, "win").otherwise("loss")


def minute(seconds: Column) -> Column:
    """Minutes with two places, half to even."""
    return F.bround(seconds / 60, 2)


def year_month(ts: Column, year: Column | None = None, month: Column | None = None) -> Column:
    """YYYY-MM from a timestamp, else from year and month; null if unknown."""
    own = F.date_format(ts, "yyyy-MM")
    if year is None:
        return own
    return F.coalesce(own, F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > lo) & (c <= hi), name).otherwise(out)
    return out


def year_bin(year: Column) -> Column:
    return bins(year, [2015, 2018, 2021, 2026], ["2016-2018", "2019-2021", "2022-2026"])


def duration_bin(seconds: Column) -> Column:
    return bins(seconds, [0, 1800, 2700, 7200], ["short", "medium", "long"])


def tier(name: Column, feed_tier: Column) -> Column:
    """Tournament tier.  A main event counts only with the year or number right behind its name, and never falls through to the next tier."""
    n = F.trim(F.coalesce(name, F.lit("")))
    numbered = n.rlike(r"(?i)\bthe international\s+(\d{2,4}|[1-9])\b") | n.rlike(r"International \d")
    return (
        F.when(F.lower(F.trim(F.coalesce(feed_tier, F.lit("")))).isin("excluded", "amateur", ""), OTHER)
        .when(n.rlike(r"(?i)qualif"), OTHER)
        .when(n.rlike(r"(?i)\bthe international\b"), F.when(numbered, "TI").otherwise(OTHER))
        .when(n.rlike(r"(?i)\bmajor\b"), "Major")
        .when(n.rlike(r"(?i)\bdpc\b|dota pro circuit|\btour [123]\b"), "DPC Tour")
        .otherwise(OTHER)
    )


def phase(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    return (
        F.when(n.rlike(r"(?i)grand final"), "grand_final").when(n.rlike(r"(?i)\bfinals?\b|playoff"), "playoffs").when(n.rlike(r"(?i)group stage"), "group_stage").otherwise(NO_PHASE)
    )


def sentiment_score(pos: Column, neg: Column, predicted: Column) -> Column:
    """P(positive) - P(negative), nulls as 0; null without a prediction."""
    none_as_0 = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))
    return F.when(predicted.isNotNull(), none_as_0(pos) - none_as_0(neg))


def argmax_label(probs: list[tuple[str, Column]]) -> Column:
    """Name of the greatest probability; the first of equals; null if all are null."""
    some = [F.when(p.isNotNull(), F.struct(p.alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(probs)]
    return F.greatest(*some)["name"] if len(some) > 1 else some[0]["name"]


def flag(p: Column, threshold: float = 0.5) -> Column:
    """1 where p >= threshold; null and NaN are 0."""
    return F.when(F.nanvl(p, F.lit(None).cast("double")) >= threshold, 1).otherwise(0)


def clean_binary(c: Column) -> Column:
    """To a number, null 0, truncated, clipped to 0..1."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("int"), F.lit(0)), F.lit(1))


def clean_sentiment(c: Column) -> Column:
    return F.lower(F.trim(c))


def game_stage(time: Column, duration: Column) -> Column:
    """Where in the match a message stands, by time over duration."""
    r = time / F.nullif(duration, F.lit(0))
    return F.when(r.isNull(), "unknown").when(time < 0, "before").when(r >= 0.95, "end").when(r >= 0.85, "late").otherwise("play")
