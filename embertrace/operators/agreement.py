"""Inter-rater agreement on the long form (item, rater, value): every statistic is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def votes(ratings: DataFrame, item: list[str], rater: str, value: str) -> DataFrame:
    """item columns, rater, value: the first value (ascending) of a rater who rated an item twice; nulls are no votes."""
    return ratings.where(F.col(value).isNotNull() & F.col(rater).isNotNull()).groupBy(*item, F.col(rater).alias("rater")).agg(F.min(value).alias("value"))


def cohen_kappa(v: DataFrame, item: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group ``by`` and pair of raters (a < b): common items, kappa; null when chance agreement is complete."""
    by = by or []
    item = [*by, *item]
    a = v.select(*item, F.col("rater").alias("a"), F.col("value").alias("va"))
    b = v.select(*item, F.col("rater").alias("b"), F.col("value").alias("vb"))
    cells = a.join(b, item).where("a < b").groupBy(*by, "a", "b", "va", "vb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.groupBy(*by, "a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("n")).otherwise(0.0)).alias("same"))
    ra = cells.groupBy(*by, "a", "b", F.col("va").alias("x")).agg(F.sum("n").alias("na"))
    rb = cells.groupBy(*by, "a", "b", F.col("vb").alias("x")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, [*by, "a", "b", "x"]).groupBy(*by, "a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    j = total.join(chance, [*by, "a", "b"], "left").withColumn("pe", F.coalesce("e", F.lit(0.0)) / F.col("n") ** 2)
    return j.select(*by, "a", "b", F.col("n").cast("long").alias("n"), ((F.col("same") / F.col("n") - F.col("pe")) / F.nullif(F.round(1 - F.col("pe"), 12), F.lit(0.0))).alias("kappa"))


def krippendorff_alpha(v: DataFrame, item: list[str], mode: str = "reference", by: list[str] | None = None) -> DataFrame:
    """One row a group ``by`` for binary values: items with two votes and more, alpha.  mode 'reference' pairs a vote with itself too, 'canonical' doesn't."""
    by = by or []
    x = v.groupBy(*by, *item).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.col("value").cast("int")).cast("double").alias("n1")).where("m > 1")
    n0, n1, m = F.col("m") - F.col("n1"), F.col("n1"), F.col("m")
    own = 0 if mode == "reference" else 1
    c = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.sum(n0 * n1 / (m - 1)).alias("c01"), F.sum(n0 * (n0 - own) / (m - 1)).alias("c00"), F.sum(n1 * (n1 - own) / (m - 1)).alias("c11"))
    n = F.col("c00") + F.col("c11") + 2 * F.col("c01")
    p0, p1 = (F.col("c00") + F.col("c01")) / n, (F.col("c11") + F.col("c01")) / n
    de = 2 * p0 * p1 * n / F.nullif(n - 1, F.lit(0.0))
    return c.select(*by, "n_items", (1 - (2 * F.col("c01") / n) / F.nullif(de, F.lit(0.0))).alias("alpha"))


def fleiss_kappa(v: DataFrame, item: list[str]) -> DataFrame:
    """panel, n_items, kappa: one row for every set of two raters or more, over the items that exactly these voted on."""
    c = v.groupBy(*item, "value").agg(F.count(F.lit(1)).cast("double").alias("n"), F.collect_set("rater").alias("r"))  # raters of one item
    of = c.groupBy(*item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("r")))), ",").alias("panel")).where("m > 1")
    pa = of.groupBy("panel").agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("pa"))
    share = c.select(*item, "value", "n").join(of.select(*item, "panel"), item).groupBy("panel", "value").agg(F.sum("n").alias("n"))
    pe = share.groupBy("panel").agg((F.sum(F.col("n") ** 2) / F.sum("n") ** 2).alias("pe"))
    return pa.join(pe, "panel").select("panel", "n_items", ((F.col("pa") - F.col("pe")) / F.nullif(F.round(1 - F.col("pe"), 12), F.lit(0.0))).alias("kappa"))


def majority(v: DataFrame, item: list[str]) -> DataFrame:
    """Per item: the most frequent value (of equals the one of the first rater), its confidence and the number of votes."""
    c = v.groupBy(*item, "value").agg(F.count(F.lit(1)).alias("c"), F.min("rater").alias("first"))
    top = c.groupBy(*item).agg(F.sum("c").alias("n_votes"), F.min(F.struct((-F.col("c")).alias("c"), "first", "value")).alias("t"))
    n = -F.col("t.c")
    conf = F.when(n == F.col("n_votes"), "unanimous").when(n > F.col("n_votes") / 2, "majority").otherwise("adjudicated")
    return top.select(*item, F.col("t.value").alias("consensus"), conf.alias("confidence"), "n_votes")
