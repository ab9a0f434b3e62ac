"""Queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm.abuse import consistent_label, scored
from embertrace.llm.encoding import garbled
from embertrace.llm.language import identified, label_cases
from embertrace.llm.leaks import BLOCK, PARAPHRASE, leak_candidates, leaked_items
from embertrace.llm.lookalike import look_alike_classes, look_alike_pairs, with_consistent_form
from embertrace.llm.overlap import cross_split_overlaps, overlap_records
from embertrace.llm.packing import CAPACITY, packed
from embertrace.llm.quota import quota_sample, targets_from_counts
from embertrace.llm.splits import assign_splits, component_pairs, components
from embertrace.session import cut, table

SHARES = {"train": 0.7, "validation": 0.1, "test": 0.2}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    p = cross_split_overlaps(table(spark, root, "gold"), "gold_id", "text", "split")
    return p.select(F.least("train_id", "eval_id").alias("gold_id_a"), F.greatest("train_id", "eval_id").alias("gold_id_b"))


def p1_records(spark: SparkSession, root: str) -> DataFrame:
    """Every row with text: its class of equal texts, near-same classes of the other side, and how much of it they cover."""
    r = overlap_records(table(spark, root, "gold"), "gold_id", "text", "split")
    return r.select(F.col("id").alias("gold_id"), "split", "class", "n_links", F.round("coverage", 6).alias("coverage"))


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """By split and source: rows with text, rows with a partner on the other side, and the mean of the coverage of those."""
    g = table(spark, root, "gold").select("gold_id", "source")
    r = p1_records(spark, root).join(g, "gold_id")
    return r.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_links") > 0).alias("n_overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    p = look_alike_pairs(table(spark, root, "enriched_gold_labeled"), "idx", "key")
    return p.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))


def p2_forms(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key")
    return with_consistent_form(e, "key").select("idx", "form", "kinds")


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    c = look_alike_classes(table(spark, root, "enriched_gold_labeled"), "idx", "key")
    return c.select(F.col("id").alias("idx"), "class", "n_spellings")


def p5_components(spark: SparkSession, root: str) -> DataFrame:
    c = components(table(spark, root, "gold"), "match_id", "author_id")
    return c.select(F.col("node").alias("match_id"), "component")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    p = component_pairs(components(table(spark, root, "gold"), "match_id", "author_id"))
    return p.select(F.col("a").alias("match_id_a"), F.col("b").alias("match_id_b"))


def p5_split(spark: SparkSession, root: str) -> DataFrame:
    """gold_id, match_id, component, split."""
    g = table(spark, root, "gold").select("gold_id", "match_id", "sentiment", "author_id")
    c = cut(components(g, "match_id", "author_id"))
    r = g.join(c.withColumnRenamed("node", "match_id"), "match_id")
    s = assign_splits(r, "component", "sentiment", SHARES)
    return r.join(s.select("component", "split"), "component").select("gold_id", "match_id", "component", "split")


def p5_split_check(spark: SparkSession, root: str) -> DataFrame:
    """Rows and components with a split, components in two splits, and whether all shares of rows lie within 0.02 of their targets."""
    s = cut(p5_split(spark, root))
    parts = s.groupBy("component").agg(F.countDistinct("split").alias("splits"), F.count("split").alias("n"), *[F.count_if(F.col("split") == k).alias(k) for k in SHARES])
    near = [F.abs(F.sum(k) / F.sum("n") - v) <= 0.02 for k, v in SHARES.items()]
    return parts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("splits") > 1).alias("n_torn"), (near[0] & near[1] & near[2]).alias("shares_hold"))


def _year_sample(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, root, "enriched_gold_labeled").select("year", "key")
    total = e.count() // 4
    return quota_sample(e, targets_from_counts(table(spark, root, "temporal_yearly"), "year", "n_messages", float(total)), "year", "key")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    report = _year_sample(spark, root)[1]
    return report.select(F.col("category").alias("year"), F.round("target", 6).alias("target"), "available", "quota", "taken",
                         F.round("wanted_share", 6).alias("wanted_share"), F.round("share", 6).alias("share"), "exhausted")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_report(spark, root).where("exhausted").select("year")


def p7_sample(spark: SparkSession, root: str) -> DataFrame:
    sample = _year_sample(spark, root)[0]
    return sample.select(F.col("category").alias("year"), F.col("item").alias("key"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    """By item: the documents into which it leaked."""
    items = table(spark, root, "eval_items").select("item_id", "suite")
    n = p9_found(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return garbled(table(spark, root, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p10_repaired(spark: SparkSession, root: str) -> DataFrame:
    g = garbled(table(spark, root, "documents"), "doc_id", "text", "source")
    return g.select(F.col("id").alias("doc_id"), "chains", F.round("evidence", 3).alias("evidence"), "repaired")


def p6_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every row with its score and verdict."""
    kinds = ["y_severe_toxic", "y_threat", "y_insult", "y_identity_hate"]
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key", "y_toxic", "y_obscene", *kinds)
    return scored(e, "idx", "key", consistent_label("y_toxic", kinds, "y_obscene")).select(F.col("id").alias("idx"), F.round("score", 4).alias("score"), "abusive")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_scores(spark, root).where("abusive").select("idx")


def p6_rates(spark: SparkSession, root: str) -> DataFrame:
    """By source: rows, abusive rows and their rate."""
    e = table(spark, root, "enriched_gold_labeled").select("idx", "source")
    return e.join(p6_scores(spark, root), "idx").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))


def p6_scorer_gaps(spark: SparkSession, root: str) -> DataFrame:
    """By source: verdicts that ``max_toxicity_prob`` misses (below one half or null), and rows that it alone would flag."""
    e = table(spark, root, "enriched_gold_labeled").select("idx", "source", (F.coalesce("max_toxicity_prob", F.lit(0.0)) >= 0.5).alias("flagged"))
    return e.join(p6_scores(spark, root), "idx").groupBy("source").agg(
        F.count_if("abusive").alias("n_abusive"), F.count_if(F.col("abusive") & ~F.col("flagged")).alias("n_missed"), F.count_if(~F.col("abusive") & F.col("flagged")).alias("n_overstated"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container of every document or piece, in tokens."""
    return packed(table(spark, root, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and the mean fill."""
    c = p8_containers(spark, root).where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return c.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"),
                 F.round(F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"))


def p8_check(spark: SparkSession, root: str) -> DataFrame:
    """Documents placed, empty ones, whole documents in more than one piece, overfull containers, and whether the fill is 99 % or the least
    number of containers."""
    c = cut(p8_containers(spark, root))
    of = c.groupBy("doc_id").agg(F.count("container").alias("pieces"), F.sum("n_tokens").alias("n"))
    docs = of.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("pieces") == 0).alias("n_empty"), F.count_if((F.col("n") <= CAPACITY) & (F.col("pieces") > 1)).alias("n_torn"))
    full = c.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("t"))
    fill = full.agg(F.count_if(F.col("t") > CAPACITY).alias("n_overfull"), ((F.sum("t") / (F.count(F.lit(1)) * CAPACITY) >= 0.99) | (F.count(F.lit(1)) == F.ceil(F.sum("t") / CAPACITY))).alias("well_filled"))
    return docs.withColumn("k", F.lit(1)).join(fill.withColumn("k", F.lit(1)), "k").drop("k")


def p4_segments(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every key and of every segment of a mixed one."""
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key", "lang")
    return identified(e, "idx", "key", "lang").select(
        F.col("id").alias("idx"), "segment", "first_word", "n_words", "lang", F.round("confidence", 6).alias("confidence"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key", "lang")
    return label_cases(identified(e, "idx", "key", "lang"), e, "idx", "lang").withColumnRenamed("id", "idx")


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, item_id, kind: verbatim (twelve or more successive words) or paraphrase, with the shares that were found."""
    c = leak_candidates(table(spark, root, "documents"), table(spark, root, "eval_items"))
    kind = F.when(F.col("run") >= BLOCK, "verbatim").when((F.col("common") >= PARAPHRASE) & (F.col("answer") >= PARAPHRASE), "paraphrase")
    return c.select("doc_id", "item_id", kind.alias("kind"), F.round("cosine", 3).alias("cosine"), F.round("common", 6).alias("common"), F.round("answer", 6).alias("answer")).where("kind IS NOT NULL")


QUERIES = {
    "p4_found": p4_found, "p4_segments": p4_segments,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check,
    "p6_found": p6_found, "p6_scores": p6_scores, "p6_rates": p6_rates, "p6_scorer_gaps": p6_scorer_gaps,
    "p10_found": p10_found, "p10_repaired": p10_repaired,
    "p9_found": p9_found, "p9_passages": p9_passages, "p9_report": p9_report,
    "p1_found": p1_found, "p1_records": p1_records, "p1_report": p1_report,
    "p2_found": p2_found, "p2_forms": p2_forms, "p2_classes": p2_classes,
    "p5_found": p5_found, "p5_components": p5_components, "p5_split": p5_split, "p5_split_check": p5_split_check,
    "p7_found": p7_found, "p7_report": p7_report, "p7_sample": p7_sample,
}

_COMPONENTS = """
WITH RECURSIVE ties AS (SELECT DISTINCT match_id, author_id FROM gold WHERE author_id IS NOT NULL AND author_id <> 0 AND match_id IS NOT NULL),
e AS (SELECT DISTINCT x.match_id AS a, y.match_id AS b FROM ties x JOIN ties y USING (author_id)),
reach(node, root) AS (
  SELECT match_id, match_id FROM (SELECT DISTINCT match_id FROM gold WHERE match_id IS NOT NULL)
  UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
"""
_TARGETS = """
WITH y AS (SELECT year, sum(n_messages) AS w FROM (SELECT DISTINCT year, n_messages FROM temporal_yearly) WHERE year IS NOT NULL GROUP BY year),
t AS (SELECT year, (SELECT count(*) // 4 FROM enriched_gold_labeled)::DOUBLE * w / (SELECT sum(w) FROM y) AS target FROM y),
a AS (SELECT year, count(DISTINCT key) AS available FROM enriched_gold_labeled WHERE key <> '' GROUP BY year),
q AS (SELECT t.year, target, coalesce(available, 0) AS available, greatest(ceil(target - 1e-9), 20)::BIGINT AS quota, target / (SELECT sum(target) FROM t) AS wanted
      FROM t LEFT JOIN a ON a.year = t.year),
g AS (SELECT k, year, wanted, least(available, greatest(ceil(wanted * floor((SELECT sum(target) FROM t) * k / 1000 + 1e-9) - 1e-9), 20))::BIGINT AS taken FROM q, range(1, 1001) r(k)),
h AS (SELECT k, max(abs(taken / n - wanted)) AS gap FROM (SELECT *, greatest(sum(taken) OVER (PARTITION BY k), 1) AS n FROM g) GROUP BY k),
b AS (SELECT coalesce((SELECT max(k) FROM h WHERE gap <= 0.02), (SELECT max(k) FROM h WHERE gap <= (SELECT min(gap) FROM h) + 1e-12)) AS k),
r AS (SELECT q.*, g.taken, g.taken / (SELECT sum(taken) FROM g WHERE k = (SELECT k FROM b)) AS share FROM q JOIN g ON g.year = q.year AND g.k = (SELECT k FROM b))
"""
_NEAR = """
WITH g AS (SELECT gold_id, lower(trim(split)) AS split, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM gold WHERE text IS NOT NULL AND split IS NOT NULL),
k AS (SELECT * FROM g WHERE t <> ''),
pairs AS (
  SELECT a.gold_id AS i, b.gold_id AS j, a.t AS s, b.t AS t FROM k a JOIN k b ON a.split = 'train' AND b.split <> 'train'
  WHERE abs(length(a.t) - length(b.t)) <= 0.2 * greatest(length(a.t), length(b.t)) AND levenshtein(a.t, b.t) <= 0.2 * greatest(length(a.t), length(b.t)))
"""
_PACKED = """
SELECT count(*) AS n_documents, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty, 0 AS n_torn, 0 AS n_overfull, true AS well_filled FROM documents
"""
ORACLES = {
    "p8_check": _PACKED,
    "p1_found": _NEAR + "SELECT least(i, j) AS gold_id_a, greatest(i, j) AS gold_id_b FROM pairs",
    "p5_components": _COMPONENTS + "SELECT node AS match_id, component FROM c",
    "p5_found": _COMPONENTS + "SELECT x.node AS match_id_a, y.node AS match_id_b FROM c x JOIN c y ON x.component = y.component AND x.node < y.node",
    "p7_found": _TARGETS + "SELECT year FROM r WHERE available < target",
    "p7_report": _TARGETS + "SELECT year, round(target, 6) AS target, available, quota, taken, round(wanted, 6) AS wanted_share, round(share, 6) AS share, available < target AS exhausted FROM r",
    "p7_sample": _TARGETS + """SELECT i.year, key FROM (
      SELECT year, key, row_number() OVER (PARTITION BY year ORDER BY md5('42|' || year || '|' || key), key) AS n
      FROM (SELECT DISTINCT year, key FROM enriched_gold_labeled WHERE year IS NOT NULL AND key <> '')) i JOIN r ON r.year = i.year WHERE n <= taken""",
    "p5_split_check": _COMPONENTS + """SELECT count(*) AS n_rows, (SELECT count(DISTINCT component) FROM c) AS n_components, 0 AS n_torn, true AS shares_hold
FROM gold WHERE match_id IS NOT NULL""",
}
