"""A sample that meets target category shares: mergeable reservoirs of the least priorities, trimmed after the final counts.

Each distinct item gets a uniform priority (an MD5 digest with a seed).  One pass over the distinct items keeps, per task and
category, a reservoir of the items with the least priorities, no larger than the category's greatest possible quota, and
counts what it has seen.  Reservoirs merge by union, since the least of a union are among the least of its parts; counts merge by
addition.  The merged reservoirs are a written table; the input isn't read again.  A task holds at most its own partition's
items, and a category with a third of all rows is spread over all tasks.

After the final counts the quotas are made feasible: the sample's size is lowered, in thousandths of the wanted size, until no category's share
misses its target by more than ``most_gap`` (or to the size with the least gap), and the reservoirs are trimmed to the least
priorities: the first four digits of the priority pick a cut-off bucket by counts, and only that bucket is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.session import cut

GRADES = 1000


def targets_from_counts(counts: DataFrame, category: str, weight: str, total) -> DataFrame:
    """category, target: ``total`` times the category's share; duplicate rows count once, null weights as 0."""
    c = counts.select(F.col(category).cast("long").alias("category"), F.col(weight).cast("double").alias("w")).distinct().where("category IS NOT NULL")
    c = c.groupBy("category").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    all_w = F.sum("w").over(Window.partitionBy(F.lit(1)))  # over the targets, a row a category
    return c.select("category", (F.lit(total) * F.col("w") / all_w).alias("target"))


def distinct_items(df: DataFrame, category: str, item: str, seed: int) -> DataFrame:
    """Distinct non-empty items per category with their priorities; null categories and items take no part."""
    d = df.select(F.col(category).cast("long").alias("category"), F.col(item).alias("item")).where("category IS NOT NULL AND item IS NOT NULL AND item <> ''").distinct()
    return d.withColumn("priority", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("category").cast("string"), "item")))


def reservoirs(items: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """category, item, priority: per task the ``sizes[category]`` least priorities; with a null item, ``seen`` counts the task's items."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        rows: dict[int, int] = {}
        seen: dict[int, int] = {}
        for f in frames:
            for c, part in f.groupby("category"):
                c = int(c)
                size = sizes.get(c, 0)
                seen[c] = seen.get(c, 0) + len(part)
                if size:
                    held.setdefault(c, []).append(part)
                    rows[c] = rows.get(c, 0) + len(part)
                    if rows[c] > 2 * size:
                        held[c] = [pd.concat(held[c]).sort_values("priority").head(size)]
                        rows[c] = size
        for c, parts in held.items():
            yield pd.concat(parts).sort_values("priority").head(sizes[c]).assign(seen=0)
        yield pd.DataFrame({"category": list(seen), "item": None, "priority": None, "seen": list(seen.values())})

    return items.select("category", "item", "priority").mapInPandas(keep, "category long, item string, priority string, seen long")


def feasible(targets: dict[int, float], available: dict[int, int], minimum: int, most_gap: float) -> dict[int, int]:
    """How many items each category gives: as many as wanted if the shares allow it, else of a smaller sample."""
    total = sum(targets.values())
    names = sorted(targets)
    if not names or total <= 0:
        return dict.fromkeys(names, 0)
    share = np.array([targets[c] / total for c in names])
    there = np.array([available.get(c, 0) for c in names])
    best = None
    for grade in range(GRADES, 0, -1):
        size = math.floor(total * grade / GRADES + 1e-9)
        taken = np.minimum(there, np.maximum(np.ceil(share * size - 1e-9), minimum)).astype(np.int64)
        gap = float(np.abs(taken / max(taken.sum(), 1) - share).max())
        if best is None or gap < best[0] - 1e-12:
            best = gap, taken
        if gap <= most_gap:
            break
    return dict(zip(names, best[1].tolist(), strict=True))


def quota_sample(
    df: DataFrame, targets: DataFrame, category: str, item: str, minimum: int = 20, seed: int = 42, most_gap: float = 0.02
) -> tuple[DataFrame, DataFrame]:
    """(sample, report).  sample: category, item; each category has exactly ``taken`` distinct items.

    targets: category, target, a bounded dimension.  report: category, target, available, quota, taken, wanted_share, share, exhausted.
    quota = max(ceil(target), minimum); exhausted: fewer available than the target; share: of the sample.
    Empty tables give an empty sample and a report with available 0.  Ties of priorities are broken by the item.
    The same seed gives the same sample whatever the partitioning.  Categories without a target are not sampled.
    """
    spark = df.sparkSession
    wanted = {r["category"]: r["target"] for r in targets.collect()}  # a row a category
    quota = {c: max(math.ceil(t - 1e-9), minimum) for c, t in wanted.items()}
    kept = cut(reservoirs(distinct_items(df, category, item, seed), quota))
    seen = {r["category"]: r["n"] for r in kept.where("item IS NULL").groupBy("category").agg(F.sum("seen").alias("n")).where(F.col("category").isin(list(wanted))).collect()}
    taken = feasible(wanted, seen, minimum, most_gap)
    total, size = sum(wanted.values()) or 1.0, sum(taken.values()) or 1
    rows = [(c, t, seen.get(c, 0), quota[c], taken[c], t / total, taken[c] / size, seen.get(c, 0) < t) for c, t in wanted.items()]
    report = spark.createDataFrame(rows, "category long, target double, available long, quota long, taken long, wanted_share double, share double, exhausted boolean")
    items = kept.where("item IS NOT NULL").withColumn("bucket", F.substring("priority", 1, 4))
    counts = items.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("category").orderBy("bucket")) - F.col("n")  # at most 65,536 buckets a category
    cuts = counts.withColumn("before", before).join(F.broadcast(report.select("category", "taken")), "category").where("before < taken")
    chosen = items.join(cuts, ["category", "bucket"])
    whole = chosen.where("before + n <= taken").select("category", "item")
    rank = F.row_number().over(Window.partitionBy("category", "bucket").orderBy("priority", "item"))
    part = chosen.where("before + n > taken").withColumn("r", rank).where("before + r <= taken").select("category", "item")
    return whole.unionByName(part), report
