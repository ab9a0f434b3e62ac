"""Series and contingency aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_series(df: DataFrame, key: Column, name: str, match: str, predicted: str, score: str, sentiments: Sequence[str], max_prob: str, flags: Sequence[str]) -> DataFrame:
    """Per period: messages, matches, sentiment shares (of all rows, unpredicted ones too), mean score, toxicity shares (null is 0)."""
    share = lambda cond: F.avg(F.coalesce(cond.cast("double"), F.lit(0.0)))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    any_flag = sum((zero(f) for f in flags), F.lit(0.0)) > 0
    return df.withColumn(name, key).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct(match).alias("n_matches"),
        *[F.round(share(F.col(predicted) == s), 6).alias(f"pct_{s}") for s in sentiments],
        F.round(F.avg(score), 4).alias("mean_sentiment_score"), F.round(share(any_flag), 6).alias("pct_toxic_any"),
        F.round(F.avg(zero(max_prob)), 4).alias("mean_toxicity_score"), *[F.round(F.avg(zero(f)), 6).alias(f"pct_{f}") for f in flags])


def fill_gaps(series: DataFrame, month: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for every month from the first to the last of each group; missing ones have nulls."""
    span = series.groupBy(*by).agg(F.min(F.to_date(F.concat(F.col(month), F.lit("-01")))).alias("a"), F.max(F.to_date(F.concat(F.col(month), F.lit("-01")))).alias("b"))
    months = span.where("a IS NOT NULL").select(*by, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("d")).select(*by, F.date_format("d", "yyyy-MM").alias(month))
    return months.join(series, [*by, month], "left")


def value_counts(df: DataFrame, cols: Sequence[str], keep_null: bool = True) -> DataFrame:
    d = df if keep_null else df.na.drop(subset=list(cols))
    return d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def row_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with the share of each cell in its row; nulls take no part."""
    c = value_counts(df, [a, b], keep_null=False)
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(a)), 6))


def top_shares(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values (ties by value) and their shares of all rows."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(k)
    return top.withColumn("share", F.round(F.col("n") / df.agg(F.count(F.lit(1))).scalar(), 6))


def five_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Inputs of a box plot: exact minimum, quartiles and maximum per group.

    Spark's exact percentile keeps value counts, so repeated values cost one entry; groups and values that are null take no part.
    """
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    d = df.na.drop(subset=[group, value]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), p.alias("p"))
    return d.select(group, "n", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])
