"""Classification metrics over long tables (model, label, y, p, score): everything comes from confusion counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.operators.sampling import ranked
from embertrace.operators.stats import running_before
from embertrace.session import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Long confusion counts; rows with a null side take no part."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class that occurs in truth or prediction: support, precision, recall, F1 (0 if undefined)."""
    t = cells.groupBy(*by, F.col("y").alias("label")).agg(F.sum("n").alias("t"))
    q = cells.groupBy(*by, F.col("p").alias("label")).agg(F.sum("n").alias("q"))
    h = cells.where("y = p").select(*by, F.col("y").alias("label"), F.col("n").alias("h"))
    keys = [*by, "label"]
    j = t.join(q, keys, "full_outer").join(h, keys, "left").na.fill(0, ["t", "q", "h"])
    return j.select(*keys, F.col("t").alias("support"), _ratio(F.col("h"), F.col("q")).alias("precision"), _ratio(F.col("h"), F.col("t")).alias("recall"),
                    _ratio(2 * F.col("h"), F.col("t") + F.col("q")).alias("f1"))


def multiclass_metrics(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """accuracy, macro F1/precision/recall over classes present, balanced accuracy, MCC per group."""
    cells = cut(confusion(df, by, y, p))  # classes squared; the rows are read once
    per = class_scores(cells, by)
    macro = per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                                 F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    tk = cells.groupBy(*by, "y").agg(F.sum("n").alias("t"))
    pk = cells.groupBy(*by, F.col("p").alias("y")).agg(F.sum("n").alias("q"))
    m = tk.join(pk, [*by, "y"], "full_outer").na.fill(0, ["t", "q"]).groupBy(*by).agg(
        F.sum(F.col("t") * F.col("q")).cast("double").alias("tq"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("q") ** 2).alias("qq"))
    s = cells.groupBy(*by).agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    j = s.join(m, list(by)).join(macro, list(by))
    den = F.sqrt((F.col("s") ** 2 - F.col("qq")) * (F.col("s") ** 2 - F.col("tt")))
    mcc = F.when(den > 0, (F.col("c") * F.col("s") - F.col("tq")) / den).otherwise(0.0)
    return j.select(*by, F.col("s").cast("long").alias("n"), (F.col("c") / F.col("s")).alias("accuracy"), "macro_f1", "macro_precision", "macro_recall", "balanced_accuracy", mcc.alias("mcc"))


def binary_counts(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """tp, fp, fn, tn per group (null labels and predictions count as 0)."""
    yy, pp = F.coalesce(F.col(y).cast("int"), F.lit(0)) > 0, F.coalesce(F.col(p).cast("int"), F.lit(0)) > 0
    return df.groupBy(*by).agg(F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"), F.count_if(yy & ~pp).alias("fn"), F.count_if(~yy & ~pp).alias("tn"))


def binary_mcc() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


def label_metrics(df: DataFrame, by: Sequence[str], label: str, y: str, p: str) -> DataFrame:
    c = binary_counts(df, [*by, label], y, p)
    return c.select(*by, label, "tp", "fp", "fn", "tn", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), binary_mcc().alias("mcc"))


def multilabel_metrics(df: DataFrame, by: Sequence[str], key: str, label: str, y: str, p: str, macro: str = "all", labels: Sequence[str] = ()) -> DataFrame:
    """micro and macro F1 and MCC, Hamming loss, subset accuracy.  macro: all labels, those with positives (supported), or the given ones (listed)."""
    per = label_metrics(df, by, label, y, p)
    counted = {"all": F.lit(True), "supported": F.col("tp") + F.col("fn") > 0, "listed": F.col(label).isin(list(labels))}[macro]
    a = per.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("cells"),
                             F.avg(F.when(counted, F.col("f1"))).alias("macro_f1"), F.avg(F.when(counted, F.col("mcc"))).alias("macro_mcc"), F.sum("tn").alias("tn"))
    yy, pp = F.coalesce(F.col(y).cast("int"), F.lit(0)), F.coalesce(F.col(p).cast("int"), F.lit(0))
    rows = df.groupBy(*by, key).agg(F.bool_and(yy == pp).alias("same")).groupBy(*by).agg(F.avg(F.col("same").cast("double")).alias("subset_accuracy"))
    return a.join(rows, list(by)).select(*by, _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"), binary_mcc().alias("micro_mcc"), "macro_f1", "macro_mcc",
                                         ((F.col("fp") + F.col("fn")) / F.col("cells")).alias("hamming"), "subset_accuracy")


def score_curves(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: positives, negatives, ROC AUC (rank statistic) and average precision over distinct scores; null if a class is absent."""
    yy = F.coalesce(F.col(y).cast("int"), F.lit(0)) > 0
    d = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy((-F.col(score).cast("double")).alias("s")).agg(
        F.count_if(yy).alias("pos"), F.count_if(~yy).alias("neg"))
    r = running_before(d, "s", ["pos", "neg"])  # before: with a higher score
    above = F.col("before_pos") + F.col("pos")
    x = r.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("lost"),
              F.sum(F.col("pos") * above / F.nullif(above + F.col("before_neg") + F.col("neg"), F.lit(0))).alias("ap"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return x.select(F.coalesce("np", F.lit(0)).alias("n_pos"), F.coalesce("nn", F.lit(0)).alias("n_neg"), F.when(both, 1 - F.col("lost") / (F.col("np") * F.col("nn"))).alias("auc"),
                    F.when(F.col("np") > 0, F.col("ap") / F.col("np")).alias("average_precision"))


def tune_threshold(df: DataFrame, by: Sequence[str], y: str, score: str, least_positives: int = 5) -> DataFrame:
    """Per group the lowest threshold of .01 to .99 with the greatest F1; 0.5 with fewer than ``least_positives``.

    Scores are first counted into the 100 steps, so the grid never multiplies the rows.
    """
    yy = F.coalesce(F.col(y).cast("int"), F.lit(0)) > 0
    step = F.least(F.floor(F.col(score) * 100 + F.lit(1e-9)), F.lit(99))
    c = df.where(F.col(score).isNotNull()).groupBy(*by, step.cast("int").alias("step")).agg(F.count_if(yy).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = c.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    grid = c.withColumn("t", F.explode(F.sequence(F.lit(1), F.greatest("step", F.lit(1))))).where("t <= step").groupBy(*by, "t").agg(F.sum("pos").alias("tp"), F.sum("n").alias("q"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("q") + F.col("all_pos"))
    best = grid.join(totals, list(by)).groupBy(*by).agg(F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("t")).alias("t"))).alias("b"))
    low = F.col("all_pos") < least_positives
    return totals.join(best, list(by), "left").select(*by, F.when(low | F.col("b").isNull(), 0.5).otherwise(-F.col("b.t") / 100).alias("threshold"), F.when(~low, F.col("b.f1")).alias("f1"))


def error_rate_by(df: DataFrame, y: str, p: str, flag: str) -> DataFrame:
    """Error rates by a flag and their difference; a null prediction is an error, a null label takes no part."""
    wrong = F.coalesce(F.col(y) != F.col(p), F.lit(True)).cast("double")
    on = F.coalesce(F.col(flag).cast("int"), F.lit(0)) > 0
    a = df.where(F.col(y).isNotNull()).agg(F.avg(F.when(on, wrong)).alias("rate_on"), F.avg(F.when(~on, wrong)).alias("rate_off"), F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"))
    return a.withColumn("delta", F.col("rate_on") - F.col("rate_off"))


def sample_errors(df: DataFrame, key: str, cell: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each cell, by a seeded hash of the key that other engines compute too; no cell is sorted whole in one task."""
    return ranked(df, list(cell), key, seed).where(F.col("_rank") <= n).drop("_rank")


def from_cells(n: np.ndarray) -> dict[str, float]:
    """accuracy, macro_f1 (over classes present), balanced accuracy and MCC of a confusion matrix (truth by prediction)."""
    total, hit, t, q = n.sum(), n.diagonal().astype(float), n.sum(axis=1).astype(float), n.sum(axis=0).astype(float)
    if not total:
        return dict.fromkeys(METRICS, 0.0)
    there = t + q > 0
    den = math.sqrt((total**2 - (q**2).sum()) * (total**2 - (t**2).sum()))
    return {"accuracy": hit.sum() / total, "macro_f1": float((2 * hit[there] / (t + q)[there]).mean()), "balanced_accuracy": float((hit[t > 0] / t[t > 0]).mean()),
            "mcc": (hit.sum() * total - (t * q).sum()) / den if den else 0.0}


METRICS = ("accuracy", "macro_f1", "balanced_accuracy", "mcc")


def bootstrap_metrics(df: DataFrame, y: str, p: str, metric: Callable[[np.ndarray], dict[str, float]] = from_cells, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, value, mean, lo, hi over resamples, for any metrics that are a function of the confusion matrix.

    Resampling n rows with replacement draws the cells' counts from a multinomial, exactly; so the cost depends on classes (whose square
    the driver holds) and resamples, not on rows.  Resamples are spread over tasks and seeded one by one.  Without rows all are 0.
    """
    spark = df.sparkSession
    cells = confusion(df, [], y, p).collect()
    names = sorted({r["y"] for r in cells} | {r["p"] for r in cells}) or [""]
    at = {x: i for i, x in enumerate(names)}
    n = np.zeros((len(names), len(names)), dtype=np.int64)
    for r in cells:
        n[at[r["y"]], at[r["p"]]] = r["n"]
    own = metric(n)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for b in f["id"]:
                got = np.random.default_rng([seed, int(b)]).multinomial(n.sum(), (n / max(n.sum(), 1)).ravel()).reshape(n.shape) if n.sum() else n
                rows += [(k, float(v)) for k, v in metric(got).items()]
            yield pd.DataFrame(rows, columns=["metric", "v"])

    a = (1 - level) / 2
    of = spark.range(resamples).mapInPandas(draw, "metric string, v double").groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(a)).alias("lo"), F.percentile("v", F.lit(1 - a)).alias("hi"))
    value = F.create_map(*[F.lit(x) for kv in own.items() for x in (kv[0], float(kv[1]))])
    return of.select("metric", F.element_at(value, F.col("metric")).alias("value"), "mean", "lo", "hi")


def conditional_rates(df: DataFrame, hit: Column, subsets: dict[str, Column]) -> DataFrame:
    """One row: size and rate of ``hit`` in each subset."""
    return df.agg(*reduce(lambda a, kv: [*a, F.count_if(kv[1]).alias(f"n_{kv[0]}"), F.avg(F.when(kv[1], hit.cast("double"))).alias(f"rate_{kv[0]}")], subsets.items(), []))
