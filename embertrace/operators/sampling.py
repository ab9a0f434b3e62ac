"""Stratified samples, splits, quotas, oversampling and weights.  Membership follows a seeded md5 order, so it is the same everywhere.

Ranks within a stratum are taken over hash shards: rows before a shard are known from counts, so a stratum with a third of all rows is
never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def ranked(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """``df`` plus _rank (from 1) within its stratum in seeded order."""
    d = df.withColumn("_o", seeded(key, seed)).withColumn("_shard", F.substring("_o", 1, 2))
    groups = [*strata, "_shard"]
    per = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c"))
    before = per.withColumn("_before", F.sum("_c").over(Window.partitionBy(*strata).orderBy("_shard")) - F.col("_c"))
    cond = [d[g].eqNullSafe(before[g]) for g in groups]
    j = d.join(before, cond).select(d["*"], before["_before"])
    own = F.row_number().over(Window.partitionBy(*groups).orderBy("_o", key))
    return j.withColumn("_rank", F.col("_before") + own).drop("_o", "_shard", "_before")


def allocation(df: DataFrame, strata: Sequence[str], target: int, minimum: int) -> DataFrame:
    """strata, size, alloc: min(minimum, size) each, the rest in proportion to what is left (half-even, capped)."""
    s = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    s = s.withColumn("base", F.least(F.lit(minimum), F.col("size"))).withColumn("cap", F.col("size") - F.col("base"))
    everything = Window.partitionBy(F.lit(1))
    q = F.greatest(F.lit(target) - F.sum("base").over(everything), F.lit(0))
    extra = F.least(F.col("cap"), F.bround(q * F.col("cap") / F.greatest(F.sum("cap").over(everything), F.lit(1)), 0).cast("long"))
    return s.select(*strata, "size", (F.col("base") + extra).alias("alloc"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, target: int, minimum: int = 50, seed: int = 42) -> DataFrame:
    """Rows with null strata take no part."""
    d = df.na.drop(subset=list(strata))
    a = allocation(d, strata, target, minimum)
    return ranked(d, strata, key, seed).join(a, list(strata)).where("_rank <= alloc").drop("_rank", "size", "alloc")


def split_sizes(counts: DataFrame, label: str, share: float) -> DataFrame:
    """label, n, held: ceil(n_all * share) rows in all, by largest remainder (ties by label)."""
    everything = Window.partitionBy(F.lit(1))
    exact = F.col("n") * F.ceil(F.sum("n").over(everything) * share) / F.sum("n").over(everything)
    c = counts.withColumn("_e", exact).withColumn("_f", F.floor(F.round("_e", 9)))
    left = F.ceil(F.sum("n").over(everything) * share) - F.sum("_f").over(everything)
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), label))
    return c.withColumn("_k", k).withColumn("_left", left).select(label, "n", (F.col("_f") + (F.col("_k") <= F.col("_left")).cast("long")).cast("long").alias("held"))


def train_test_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` plus split (train or test), stratified by label; null labels take no part."""
    d = df.na.drop(subset=[label])
    s = split_sizes(d.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, share).drop("n")
    return ranked(d, [label], key, seed).join(s, label).withColumn("split", F.when(F.col("_rank") <= F.col("held"), "test").otherwise("train")).drop("_rank", "held")


def validation_fraction(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Per class half-even share*n rows."""
    d = df.na.drop(subset=[label])
    s = d.groupBy(label).agg(F.bround(F.count(F.lit(1)) * share, 0).cast("long").alias("held"))
    return ranked(d, [label], key, seed).join(s, label).where("_rank <= held").drop("_rank", "held")


def quota_by_flag(df: DataFrame, group: str, flag: str, key: str, flagged: int, total: int, seed: int = 42) -> DataFrame:
    """Per group at most ``flagged`` flagged rows, filled up to ``total`` from the others."""
    d = df.na.drop(subset=[group]).withColumn("_f", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    n = d.groupBy(group).agg(F.least(F.count_if("_f"), F.lit(flagged)).alias("_n"))
    return ranked(d, [group, "_f"], key, seed).join(n, group).where(F.when(F.col("_f"), F.col("_rank") <= flagged).otherwise(F.col("_rank") <= total - F.col("_n"))).drop("_f", "_rank", "_n")


def oversample(df: DataFrame, label: str, key: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Add draws with replacement to classes under round(fraction * largest); column ``draw`` is 0 for the original rows."""
    d = df.na.drop(subset=[label])
    c = d.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("lack", F.greatest(F.bround(F.max("c").over(Window.partitionBy(F.lit(1))) * fraction, 0).cast("long") - F.col("c"), F.lit(0)))
    draws = c.where("lack > 0").select(label, "c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lack"))).alias("draw"))
    picked = draws.withColumn("_rank", F.pmod(F.xxhash64(F.lit(seed), label, "draw"), F.col("c")) + 1).drop("c")
    again = ranked(d, [label], key, seed).join(picked, [label, "_rank"]).drop("_rank")
    return d.withColumn("draw", F.lit(0).cast("long")).unionByName(again)


def class_weights(df: DataFrame, label: str, labels: Sequence[str], root: bool = False) -> DataFrame:
    """label, n, weight = n_all / (k * n), with classes that don't occur counted as 1."""
    want = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    c = want.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    w = F.sum("n").over(Window.partitionBy(F.lit(1))) / (len(labels) * F.col("n"))
    return c.select(label, "n", (F.sqrt(w) if root else w).alias("weight"))


def positive_weights(df: DataFrame, labels: Sequence[str], cap: float = 50.0) -> DataFrame:
    """label, weight = min(cap, negatives / positives); cap without positives."""
    long = df.select(*[F.coalesce(F.col(x).cast("int"), F.lit(0)).alias(x) for x in labels]).unpivot([], list(labels), "label", "v")
    c = long.groupBy("label").agg(F.count_if(F.col("v") > 0).alias("pos"), F.count_if(F.col("v") <= 0).alias("neg"))
    return c.select("label", F.when(F.col("pos") > 0, F.least(F.lit(cap), F.col("neg") / F.col("pos"))).otherwise(cap).alias("weight"))
