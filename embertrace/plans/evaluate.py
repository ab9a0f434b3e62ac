"""Queries of evaluation, agreement and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.functions import context as C
from embertrace.functions import text as T
from embertrace.operators import agreement as G
from embertrace.operators import evaluate as E
from embertrace.operators import joins as J
from embertrace.operators import sampling as N
from embertrace.operators.rules import PROPOSALS, QUESTION_ID, STRONG_ID, WEAK_ID, apply_proposals, chat_rules, is_indonesian, lexicon_scorer, propose_indonesian, score_in_batches
from embertrace.plans.context import LABELS, TOX
from embertrace.plans.text import _S, _alpha, _list, _q, _rules_sql, _strip
from embertrace.session import cut, table

KEY = list(J.MESSAGE_KEY)


def predicted(spark, root):
    """Gold rows with the labels of two models: the chat rules, and the profanity lexicon mapped to negative or neutral."""
    lexicon = F.when(F.coalesce("key", F.lit("")).rlike(T.PROFANITY), "negative").otherwise("neutral")
    return table(spark, root, "gold").select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("sentiment"), "is_dota_jargon",
                                             F.coalesce(chat_rules().label()["sentiment"], F.lit("neutral")).alias("predicted"), lexicon.alias("lexicon"))


def models(spark, root):
    """Both models in long form."""
    return predicted(spark, root).select("gold_id", "sentiment", F.col("predicted").alias("rules"), "lexicon").unpivot(["gold_id", "sentiment"], ["rules", "lexicon"], "model", "predicted")


def tox_long(spark, root):
    """Labelled rows in long form, six labels: label, score of the weak scorer, and a prediction (the detector's for toxic, else the score's)."""
    e = table(spark, root, "enriched_gold_labeled").where("y_toxic IS NOT NULL")
    e = e.select("idx", "year", F.col("max_toxicity_prob").alias("score"), "detox_pred_toxic", *[F.coalesce(f"y_{x}", F.lit(0)).alias(x) for x in TOX])
    long = e.unpivot(["idx", "year", "score", "detox_pred_toxic"], list(TOX), "label", "y")
    return long.select("idx", "year", "label", "y", "score", F.when(F.col("label") == "toxic", F.coalesce("detox_pred_toxic", F.lit(0))).otherwise(C.flag(F.col("score"))).alias("p"))


_RULE_SENTIMENT = "CASE WHEN category IN ('insult', 'ez_win', 'forfeit', 'obscene', 'gg_early') THEN 'negative' WHEN category IN ('laughter', 'sport', 'gg_end') THEN 'positive' ELSE 'neutral' END"
_P = f"""q AS (SELECT gold_id, lower(trim(sentiment)) AS sentiment, is_dota_jargon, {_RULE_SENTIMENT} AS predicted,
  CASE WHEN regexp_matches(coalesce(key, ''), '{T.PROFANITY}') THEN 'negative' ELSE 'neutral' END AS lexicon FROM ({_rules_sql('gold')}))"""
_MODELS = f"""{_P}, md AS (SELECT 'rules' AS model, gold_id, sentiment, predicted FROM q UNION ALL SELECT 'lexicon', gold_id, sentiment, lexicon FROM q),
ce AS (SELECT model, sentiment AS y, predicted AS p, count(*)::DOUBLE AS n FROM md WHERE sentiment IS NOT NULL GROUP BY ALL),
tk AS (SELECT model, y AS l, sum(n) AS t, sum(CASE WHEN y = p THEN n ELSE 0 END) AS h FROM ce GROUP BY ALL), pk AS (SELECT model, p AS l, sum(n) AS q FROM ce GROUP BY ALL),
pc AS (SELECT coalesce(tk.model, pk.model) AS model, coalesce(tk.l, pk.l) AS label, coalesce(t, 0) AS t, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM tk FULL JOIN pk ON tk.model = pk.model AND tk.l = pk.l),
sc AS (SELECT model, label, t AS support, CASE WHEN q > 0 THEN h / q ELSE 0 END AS prec, CASE WHEN t > 0 THEN h / t ELSE 0 END AS rec, CASE WHEN t + q > 0 THEN 2 * h / (t + q) ELSE 0 END AS f1, t, q, h FROM pc)"""
_TL = "tl AS (" + " UNION ALL ".join(
    f"SELECT idx, year, '{x}' AS label, coalesce(y_{x}, 0) AS y, max_toxicity_prob AS score, " + ("coalesce(detox_pred_toxic, 0)" if x == "toxic" else "coalesce((max_toxicity_prob >= 0.5)::INT, 0)")
    + " AS p FROM enriched_gold_labeled WHERE y_toxic IS NOT NULL" for x in TOX) + ")"
_TOX = f"""{_TL},
lc AS (SELECT label, sum((y > 0 AND p > 0)::INT)::DOUBLE AS tp, sum((y = 0 AND p > 0)::INT)::DOUBLE AS fp, sum((y > 0 AND p = 0)::INT)::DOUBLE AS fn, sum((y = 0 AND p = 0)::INT)::DOUBLE AS tn FROM tl GROUP BY 1),
lm AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM lc)"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def confusion(spark: SparkSession, root: str) -> DataFrame:
    return E.confusion(models(spark, root), ["model"], "sentiment", "predicted")


def sentiment_metrics(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(E.multiclass_metrics(models(spark, root), ["model"], "sentiment", "predicted"), "accuracy", "macro_f1", "macro_precision", "macro_recall", "balanced_accuracy", "mcc")


def class_scores(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(E.class_scores(E.confusion(models(spark, root), ["model"], "sentiment", "predicted"), ["model"]), "precision", "recall", "f1")


def label_metrics(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(E.label_metrics(tox_long(spark, root), [], "label", "y", "p"), "f1", "mcc")


def multilabel_metrics(spark: SparkSession, root: str) -> DataFrame:
    d = E.multilabel_metrics(tox_long(spark, root).withColumn("model", F.lit("m")), ["model"], "idx", "label", "y", "p")
    return _rounded(d, "micro_f1", "micro_mcc", "macro_f1", "macro_mcc", "hamming", "subset_accuracy")


def label_curves(spark: SparkSession, root: str) -> DataFrame:
    """ROC AUC and average precision of each label, of all cells together (micro) and on average (macro)."""
    t = cut(tox_long(spark, root).select("label", "y", "score"))
    per = None
    for x in TOX:
        one = E.score_curves(t.where(F.col("label") == x), "y", "score").select(F.lit(x).alias("label"), "auc", "average_precision")
        per = one if per is None else per.unionByName(one)
    per = cut(per)
    macro = per.agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"), F.avg("average_precision").alias("average_precision"))
    micro = E.score_curves(t, "y", "score").select(F.lit("micro").alias("label"), "auc", "average_precision")
    return _rounded(per.unionByName(macro).unionByName(micro), "auc", "average_precision")


def thresholds_applied(spark: SparkSession, root: str) -> DataFrame:
    """Thresholds tuned on the years before 2022, applied to the years from 2022 on: F1 there with them and with one half."""
    t = tox_long(spark, root).where("year IS NOT NULL")
    best = E.tune_threshold(t.where("year < 2022"), ["label"], "y", "score").select("label", "threshold")
    step = F.floor(F.coalesce("score", F.lit(0.0)) * 100 + F.lit(1e-9))
    x = t.where("year >= 2022").join(best, "label")
    x = x.withColumn("tuned", step >= F.round(F.col("threshold") * 100)).withColumn("half", step >= 50)
    f1 = lambda p: F.round(F.when(F.count_if(F.col(p)) + F.count_if("pos") > 0, 2 * F.count_if(F.col(p) & F.col("pos")) / (F.count_if(F.col(p)) + F.count_if("pos"))).otherwise(0.0), 6)
    return x.withColumn("pos", F.col("y") > 0).groupBy("label", "threshold").agg(f1("tuned").alias("f1_tuned"), f1("half").alias("f1_half"))


def average_precision(spark: SparkSession, root: str) -> DataFrame:
    """ROC AUC and average precision of the weak scorer on the labelled rows."""
    e = table(spark, root, "enriched_gold_labeled").select("y_toxic", "max_toxicity_prob").where("y_toxic IS NOT NULL")
    return _rounded(E.score_curves(e, "y_toxic", "max_toxicity_prob"), "auc", "average_precision")


def threshold_tune(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(E.tune_threshold(tox_long(spark, root), ["label"], "y", "score"), "f1")


def model_compare(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of two models side by side, and the difference."""
    m = E.multiclass_metrics(models(spark, root), ["model"], "sentiment", "predicted").select("model", F.explode(F.create_map(
        F.lit("accuracy"), F.col("accuracy"), F.lit("macro_f1"), F.col("macro_f1"), F.lit("mcc"), F.col("mcc"))).alias("metric", "value"))
    d = m.groupBy("metric").pivot("model", ["rules", "lexicon"]).agg(F.max("value"))
    return d.select("metric", F.round("rules", 6).alias("rules"), F.round("lexicon", 6).alias("lexicon"), F.round(F.col("rules") - F.col("lexicon"), 6).alias("delta"))


def jargon_error(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(E.error_rate_by(predicted(spark, root), "sentiment", "predicted", "is_dota_jargon"), "rate_on", "rate_off", "delta")


def blind_spot_recall(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").where("y_toxic IS NOT NULL")
    toxic, lex, low = F.col("y_toxic") > 0, F.coalesce("lex", F.lit(False)), F.coalesce("max_toxicity_prob", F.lit(0.0)) < 0.5
    return _rounded(E.conditional_rates(e, F.coalesce("detox_pred_toxic", F.lit(0)) > 0, {"toxic": toxic, "lexicon": toxic & lex, "low_score": toxic & low}), "rate_toxic", "rate_lexicon", "rate_low_score")


def error_samples(spark: SparkSession, root: str) -> DataFrame:
    p = predicted(spark, root).where("sentiment IS NOT NULL AND sentiment <> predicted")
    return E.sample_errors(p.select("gold_id", "sentiment", "predicted"), "gold_id", ["sentiment", "predicted"], 5)


def label_error_samples(spark: SparkSession, root: str) -> DataFrame:
    t = tox_long(spark, root).where("y <> p").select("idx", "label", F.when(F.col("p") == 1, "fp").otherwise("fn").alias("error_type"))
    return E.sample_errors(t, "idx", ["label", "error_type"], 4)


def bootstrap_ci(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the rule labels on annotated rows, and whether their 95 % intervals over resamples hold them."""
    g = table(spark, root, "gold").select(C.clean_sentiment(F.col("sentiment")).alias("s"), F.coalesce(chat_rules().label()["sentiment"], F.lit("neutral")).alias("r")).where(F.col("s").isin(*LABELS))
    b = E.bootstrap_metrics(g, "s", "r")
    return b.select("metric", F.round("value", 6).alias("value"), ((F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi")) & (F.abs(F.col("mean") - F.col("value")) < 0.05)).alias("held"))


def _votes(spark, root):
    """label, text, rater, value: votes on all six labels."""
    g = table(spark, root, "gold").where("text <> ''").select("text", "annotator_id", *[F.col(f"tox_{x}").alias(x) for x in TOX])
    return G.votes(g.unpivot(["text", "annotator_id"], list(TOX), "label", "v"), ["label", "text"], "annotator_id", "v")


_VOTES = "v AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, text, annotator_id AS rater, min(tox_{x}) AS value FROM gold WHERE text <> '' AND annotator_id IS NOT NULL AND tox_{x} IS NOT NULL GROUP BY ALL" for x in TOX) + ")"


def cohen_kappa(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(G.cohen_kappa(_votes(spark, root), ["text"], ["label"]), "kappa")


def krippendorff_alpha(spark: SparkSession, root: str) -> DataFrame:
    """By label and mode, and the mean over the labels that have one."""
    v = cut(_votes(spark, root))
    both = G.krippendorff_alpha(v, ["text"], by=["label"]).withColumn("mode", F.lit("reference")).unionByName(G.krippendorff_alpha(v, ["text"], "canonical", ["label"]).withColumn("mode", F.lit("canonical")))
    mean = both.groupBy("mode").agg(F.lit("mean").alias("label"), F.sum("n_items").alias("n_items"), F.avg("alpha").alias("alpha"))
    return _rounded(both.unionByName(mean), "alpha")


def fleiss_kappa(spark: SparkSession, root: str) -> DataFrame:
    """Kappa of every panel: the texts that exactly the same annotators labelled."""
    return _rounded(G.fleiss_kappa(_votes(spark, root).where("label = 'toxic'"), ["text"]), "kappa")


def capped_classes(spark: SparkSession, root: str) -> DataFrame:
    """At most 60 rows of each class in seeded order (a balanced training sample)."""
    g = table(spark, root, "gold").select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("s")).where("s IS NOT NULL")
    return N.ranked(g, ["s"], "gold_id", 42).where("_rank <= 60").drop("_rank")


def row_parity(spark: SparkSession, root: str) -> DataFrame:
    """By source: rows of a table, and rows with a score after batched scoring by key; scoring loses and repeats none."""
    g = table(spark, root, "gold").select("gold_id", F.coalesce("source", F.lit("none")).alias("source"), "text")
    scored = score_in_batches(g, ["gold_id", "source"], "text", lexicon_scorer, ["toxic"])
    before, after = g.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")), scored.groupBy("source").agg(F.count_distinct("gold_id").alias("n_scored"), F.count("prob_toxic").alias("n_scores"))
    return before.join(after, "source", "left")


def inner_by_id(spark: SparkSession, root: str) -> DataFrame:
    """Two tables joined by id: lines by the priority of their order."""
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, root, "lineitem").select("l_orderkey", "l_quantity").join(o, "l_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def gold_loader(spark: SparkSession, root: str) -> DataFrame:
    """Training rows: prepared text, label id; without rows that lack either."""
    ids = {x: i for i, x in enumerate(LABELS)}
    g = table(spark, root, "gold").select("gold_id", F.coalesce("text", F.lit("")).alias("text"), C.clean_sentiment(F.col("sentiment")).alias("s"))
    g = g.select("gold_id", T.norm_full(F.col("text")).alias("text"), F.try_element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), "s").alias("label"))
    return g.where("text <> '' AND label IS NOT NULL")


def augmented_training(spark: SparkSession, root: str) -> DataFrame:
    """External labelled rows together with in-domain positives, by origin and label."""
    ext = table(spark, root, "enriched_gold_labeled").where("y_toxic IS NOT NULL AND key <> ''").select(F.lit("external").alias("origin"), F.col("key").alias("text"), F.col("y_toxic").alias("y"))
    own = table(spark, root, "gold").where("split = 'train' AND text <> '' AND tox_toxic > 0").select(F.lit("own").alias("origin"), "text", F.col("tox_toxic").alias("y"))
    return ext.unionByName(own).groupBy("origin", "y").agg(F.count(F.lit(1)).alias("n"))


def prefix_split(spark: SparkSession, root: str) -> DataFrame:
    """The first 5 % in seeded order become validation rows."""
    g = N.ranked(table(spark, root, "gold").select("gold_id", F.lit(1).alias("all")), ["all"], "gold_id", 7)
    n = F.count(F.lit(1)).over(Window.partitionBy("all"))
    return g.withColumn("split", F.when(F.col("_rank") <= F.floor(n * 0.05), "validation").otherwise("train")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("gold_id").alias("least"))


def proposals_applied(spark: SparkSession, root: str) -> DataFrame:
    """Indonesian messages with proposed and corrected labels, counted."""
    e = table(spark, root, "enriched_gold_labeled").select("key").where(is_indonesian(F.col("key")))
    fixes = table(spark, root, "gold").where("text <> '' AND sentiment IS NOT NULL").select("text", C.clean_sentiment(F.col("sentiment")).alias("corrected"))
    d = apply_proposals(e.withColumn("x", propose_indonesian(F.col("key"))), "key", "x", fixes)
    return d.groupBy(F.col("x.reason").alias("reason"), "label").agg(F.count(F.lit(1)).alias("n"))


def majority_vote(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select("text", "annotator_id", C.clean_sentiment(F.col("sentiment")).alias("s")).where("text <> ''")
    return G.majority(G.votes(g, ["text"], "annotator_id", "s"), ["text"])


def consolidate(spark: SparkSession, root: str) -> DataFrame:
    """One row a text: consensus of sentiment and of the six labels."""
    s = majority_vote(spark, root).select("text", F.col("consensus").alias("sentiment"), "confidence", "n_votes")
    t = G.majority(_votes(spark, root), ["label", "text"]).groupBy("text").pivot("label", list(TOX)).agg(F.max("consensus"))
    return s.join(t, "text", "full_outer").select("text", "sentiment", F.coalesce("confidence", F.lit("missing")).alias("confidence"), "n_votes", *TOX)


def stratified_allocation(spark: SparkSession, root: str) -> DataFrame:
    return N.allocation(table(spark, root, "processed").na.drop(subset=["year", "tier"]), ["year", "tier"], 2000, 50)


def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    return N.stratified_sample(table(spark, root, "gold").select("gold_id", "year", "split"), ["year", "split"], "gold_id", 200, 5)


def train_test_split(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("s"))
    return N.train_test_split(g, "s", "gold_id", 0.3)


def validation_counts(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").where("split = 'train'").select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("s"))
    return N.validation_fraction(g, "s", "gold_id", 0.1).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def quota_sample(spark: SparkSession, root: str) -> DataFrame:
    return N.quota_by_flag(table(spark, root, "enriched_gold_labeled").select("idx", "year", "lex"), "year", "lex", "idx", 11, 22)


def oversample_counts(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("s"))
    return N.oversample(g, "s", "gold_id", 0.3).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def class_weights(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select(C.clean_sentiment(F.col("sentiment")).alias("s"))
    return N.class_weights(g, "s", LABELS).withColumn("weight", F.round("weight", 6))


def positive_weights(spark: SparkSession, root: str) -> DataFrame:
    return N.positive_weights(table(spark, root, "gold"), [f"tox_{x}" for x in TOX]).withColumn("weight", F.round("weight", 6))


def candidate_pool(spark: SparkSession, root: str) -> DataFrame:
    """Rows with a lexicon word or a high score whose text isn't annotated, one per lower-case text, by year."""
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key", "year", "max_toxicity_prob").where("key <> ''")
    e = e.where(F.col("key").rlike(T.PROFANITY) | (F.coalesce("max_toxicity_prob", F.lit(0.0)) >= 0.5)).withColumn("low", F.lower("key"))
    d = J.anti_by_key(e, table(spark, root, "gold").select(F.lower("key").alias("low")), ["low"])
    return J.keep_first(d, ["low"], ["idx"]).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def gold_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """Test rows with rule labels against annotation: one plan from scan to metrics."""
    g = table(spark, root, "gold").where("split = 'test'").withColumn("s", C.clean_sentiment(F.col("sentiment")))
    g = g.withColumn("r", F.coalesce(chat_rules().label()["sentiment"], F.lit("neutral"))).where(F.col("s").isin(*LABELS))
    return _rounded(E.multiclass_metrics(g.withColumn("model", F.lit("rules")), ["model"], "s", "r").select("model", "n", "accuracy", "macro_recall"), "accuracy", "macro_recall")


QUERIES = {f.__name__: f for f in (
    confusion, sentiment_metrics, class_scores, label_metrics, multilabel_metrics, label_curves, average_precision, threshold_tune, thresholds_applied, model_compare, jargon_error, blind_spot_recall, error_samples, label_error_samples,
    bootstrap_ci, cohen_kappa, fleiss_kappa, capped_classes, row_parity, inner_by_id, gold_loader, augmented_training, prefix_split, proposals_applied, krippendorff_alpha, majority_vote, consolidate, stratified_allocation, stratified_sample, train_test_split, validation_counts, quota_sample, oversample_counts,
    class_weights, positive_weights, candidate_pool, gold_pipeline)}

_MM = """, mm AS (SELECT sc.model, sum(support) AS n, sum(h) AS c, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq, avg(f1) AS macro_f1, avg(prec) AS macro_precision, avg(rec) AS macro_recall,
  avg(rec) FILTER (WHERE support > 0) AS balanced_accuracy FROM sc GROUP BY 1),
mx AS (SELECT *, c / n AS accuracy, CASE WHEN (n * n - qq) * (n * n - tt) > 0 THEN (c * n - tq) / sqrt((n * n - qq) * (n * n - tt)) ELSE 0 END AS mcc FROM mm)"""
_ERR = "avg((sentiment <> predicted)::INT) FILTER (WHERE coalesce(is_dota_jargon, 0) {0})"
_MAJ = """ct AS (SELECT text, value, count(*) AS c, min(rater) AS first FROM v GROUP BY ALL),
mj AS (SELECT text, value AS consensus, sum(c) OVER (PARTITION BY text) AS n_votes, c FROM ct QUALIFY row_number() OVER (PARTITION BY text ORDER BY c DESC, first, value) = 1)"""
_CONF = "CASE WHEN c = n_votes THEN 'unanimous' WHEN c > n_votes / 2 THEN 'majority' ELSE 'adjudicated' END"
_SV = "SELECT text, annotator_id AS rater, min(lower(trim(sentiment))) AS value FROM gold WHERE text <> '' AND annotator_id IS NOT NULL AND sentiment IS NOT NULL GROUP BY ALL"
_ALLOC = """SELECT {k}, size, base + least(size - base, round_even(greatest({t} - sum(base) OVER (), 0) * (size - base) / greatest(sum(size - base) OVER (), 1), 0)::BIGINT) AS alloc
FROM (SELECT {k}, count(*) AS size, least({m}, count(*)) AS base FROM {s} GROUP BY ALL)"""


_TUNE = """tg AS (SELECT label, t, 2.0 * sum((y > 0)::INT) FILTER (WHERE s >= t) / (count(*) FILTER (WHERE s >= t) + sum((y > 0)::INT)) AS f1, sum((y > 0)::INT) AS ap
  FROM (SELECT label, y, least(floor(score * 100 + 1e-9), 99) AS s FROM {0} WHERE score IS NOT NULL), (SELECT unnest(range(1, 100))::DOUBLE AS t) GROUP BY label, t HAVING count(*) FILTER (WHERE s >= t) > 0),
tuned AS (SELECT label, CASE WHEN max(ap) < 5 THEN 0.5 ELSE arg_max(t, round(f1, 12) * 1e6 - t) / 100 END AS threshold, CASE WHEN max(ap) >= 5 THEN round(max(f1), 6) END AS f1 FROM tg GROUP BY label)"""


ORACLES = {
    "confusion": f"WITH {_MODELS} SELECT model, y, p, n::BIGINT AS n FROM ce",
    "sentiment_metrics": f"WITH {_MODELS}{_MM} SELECT model, n::BIGINT AS n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(balanced_accuracy, 6) AS balanced_accuracy, round(mcc, 6) AS mcc FROM mx",
    "class_scores": f"WITH {_MODELS} SELECT model, label, support::BIGINT AS support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM sc",
    "label_metrics": f"WITH {_TOX} SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM lm",
    "multilabel_metrics": f"""WITH {_TOX}, rw AS (SELECT idx, bool_and((y > 0) = (p > 0)) AS same FROM tl GROUP BY 1),
sm AS (SELECT sum(tp) AS a, sum(fp) AS b, sum(fn) AS c, sum(tn) AS d FROM lm)
SELECT 'm' AS model, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, (SELECT round((a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)), 6) FROM sm) AS micro_mcc, round(avg(f1), 6) AS macro_f1, round(avg(mcc), 6) AS macro_mcc, round((sum(fp) + sum(fn)) / sum(tp + fp + fn + tn), 6) AS hamming,
  (SELECT round(avg(same::INT), 6) FROM rw) AS subset_accuracy FROM lm""",
    "average_precision": """WITH d AS (SELECT max_toxicity_prob AS s, count(*) FILTER (WHERE y_toxic > 0)::DOUBLE AS pos, count(*) FILTER (WHERE y_toxic = 0)::DOUBLE AS neg FROM enriched_gold_labeled WHERE y_toxic IS NOT NULL AND max_toxicity_prob IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(neg) OVER (ORDER BY s) - neg AS below, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM d)
SELECT max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(pos * (below + neg / 2)) / max(np * nn), 6) AS auc, round(sum(pos * tp / (tp + fp)) / max(np), 6) AS average_precision FROM c""",
    "threshold_tune": f"WITH {_TL}, {_TUNE.format('tl')} SELECT label, threshold, f1 FROM tuned",
    "thresholds_applied": f"""WITH {_TL}, {_TUNE.format('(SELECT * FROM tl WHERE year < 2022)')},
x AS (SELECT tl.label, y > 0 AS pos, threshold, floor(coalesce(score, 0) * 100 + 1e-9) >= round(threshold * 100) AS tuned, floor(coalesce(score, 0) * 100 + 1e-9) >= 50 AS half FROM tl JOIN tuned ON tuned.label = tl.label WHERE year >= 2022)
SELECT label, threshold, round(CASE WHEN sum(tuned::INT) + sum(pos::INT) > 0 THEN 2 * sum((tuned AND pos)::INT) / (sum(tuned::INT) + sum(pos::INT)) ELSE 0 END, 6) AS f1_tuned,
  round(CASE WHEN sum(half::INT) + sum(pos::INT) > 0 THEN 2 * sum((half AND pos)::INT) / (sum(half::INT) + sum(pos::INT)) ELSE 0 END, 6) AS f1_half FROM x GROUP BY ALL""",
    "label_curves": f"""WITH {_TL}, g AS (SELECT label, y, score FROM tl WHERE score IS NOT NULL UNION ALL SELECT 'micro', y, score FROM tl WHERE score IS NOT NULL),
d AS (SELECT label, score AS s, count(*) FILTER (WHERE y > 0)::DOUBLE AS pos, count(*) FILTER (WHERE y = 0)::DOUBLE AS neg FROM g GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY label ORDER BY s DESC) AS fp, sum(neg) OVER (PARTITION BY label ORDER BY s) - neg AS below,
  sum(pos) OVER (PARTITION BY label) AS np, sum(neg) OVER (PARTITION BY label) AS nn FROM d),
r AS (SELECT label, sum(pos * (below + neg / 2)) / max(np * nn) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c GROUP BY label)
SELECT label, round(auc, 6) AS auc, round(ap, 6) AS average_precision FROM r UNION ALL SELECT 'macro', round(avg(auc), 6), round(avg(ap), 6) FROM r WHERE label <> 'micro'""",
    "model_compare": f"WITH {_MODELS}{_MM}, z AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, max({m}) FILTER (WHERE model = 'rules') AS a, max({m}) FILTER (WHERE model = 'lexicon') AS b FROM mx" for m in ("accuracy", "macro_f1", "mcc"))
    + ") SELECT metric, round(a, 6) AS rules, round(b, 6) AS lexicon, round(a - b, 6) AS delta FROM z",
    "jargon_error": f"WITH {_P} SELECT round({_ERR.format('> 0')}, 6) AS rate_on, round({_ERR.format('= 0')}, 6) AS rate_off, count(*) FILTER (WHERE is_dota_jargon > 0) AS n_on, count(*) FILTER (WHERE coalesce(is_dota_jargon, 0) = 0) AS n_off, round({_ERR.format('> 0')} - {_ERR.format('= 0')}, 6) AS delta FROM q WHERE sentiment IS NOT NULL",
    "blind_spot_recall": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}, round(avg((coalesce(detox_pred_toxic, 0) > 0)::INT) FILTER (WHERE {c}), 6) AS rate_{n}" for n, c in (
        ("toxic", "y_toxic > 0"), ("lexicon", "y_toxic > 0 AND coalesce(lex, false)"), ("low_score", "y_toxic > 0 AND coalesce(max_toxicity_prob, 0) < 0.5"))) + " FROM enriched_gold_labeled WHERE y_toxic IS NOT NULL",
    "error_samples": f"WITH {_P} SELECT gold_id, sentiment, predicted FROM q WHERE sentiment IS NOT NULL AND sentiment <> predicted QUALIFY row_number() OVER (PARTITION BY sentiment, predicted ORDER BY md5('42:' || gold_id), gold_id) <= 5",
    "label_error_samples": f"WITH {_TOX} SELECT idx, label, CASE WHEN p = 1 THEN 'fp' ELSE 'fn' END AS error_type FROM tl WHERE y <> p QUALIFY row_number() OVER (PARTITION BY label, p ORDER BY md5('42:' || idx), idx) <= 4",
    "cohen_kappa": f"""WITH {_VOTES}, c AS (SELECT x.label, x.rater AS a, y.rater AS b, x.value AS va, y.value AS vb FROM v x JOIN v y ON x.label = y.label AND x.text = y.text AND x.rater < y.rater),
s AS (SELECT label, a, b, count(*)::DOUBLE AS n, avg((va = vb)::INT) AS po, avg(va) * avg(vb) + (1 - avg(va)) * (1 - avg(vb)) AS pe FROM c GROUP BY ALL)
SELECT label, a, b, n::BIGINT AS n, round((po - pe) / nullif(round(1 - pe, 12), 0), 6) + 0 AS kappa FROM s""",
    "krippendorff_alpha": f"WITH {_VOTES}, i AS (SELECT label, text, count(*)::DOUBLE AS m, sum(value)::DOUBLE AS n1 FROM v GROUP BY ALL HAVING count(*) > 1), " + ", ".join(
        f"c{o} AS (SELECT label, count(*) AS n_items, sum((m - n1) * n1 / (m - 1)) AS c01, sum((m - n1) * (m - n1 - {o}) / (m - 1)) AS c00, sum(n1 * (n1 - {o}) / (m - 1)) AS c11 FROM i GROUP BY label), d{o} AS (SELECT *, c00 + c11 + 2 * c01 AS n FROM c{o})" for o in (0, 1))
    + ", z AS (" + " UNION ALL ".join(f"SELECT label, n_items, 1 - (2 * c01 / n) / nullif(2 * ((c00 + c01) / n) * ((c11 + c01) / n) * n / nullif(n - 1, 0), 0) AS alpha, '{m}' AS mode FROM d{o}" for o, m in ((0, "reference"), (1, "canonical")))
    + ") SELECT label, n_items, round(alpha, 6) AS alpha, mode FROM z UNION ALL SELECT 'mean', sum(n_items)::BIGINT, round(avg(alpha), 6), mode FROM z GROUP BY mode",
    "fleiss_kappa": f"""WITH {_VOTES}, i AS (SELECT text, string_agg(rater, ',' ORDER BY rater) AS panel, count(*)::DOUBLE AS m, sum(value)::DOUBLE AS n1 FROM v WHERE label = 'toxic' GROUP BY text HAVING count(*) > 1),
s AS (SELECT panel, count(*) AS n_items, avg((n1 * (n1 - 1) + (m - n1) * (m - n1 - 1)) / (m * (m - 1))) AS pa, sum(n1) / sum(m) AS p1 FROM i GROUP BY panel)
SELECT panel, n_items, round((pa - (p1 * p1 + (1 - p1) * (1 - p1))) / nullif(round(1 - (p1 * p1 + (1 - p1) * (1 - p1)), 12), 0), 6) AS kappa FROM s""",
    "capped_classes": "SELECT gold_id, lower(trim(sentiment)) AS s FROM gold WHERE sentiment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(sentiment)) ORDER BY md5('42:' || gold_id), gold_id) <= 60",
    "row_parity": "SELECT coalesce(source, 'none') AS source, count(*) AS n_rows, count(DISTINCT gold_id) AS n_scored, count(*) AS n_scores FROM gold GROUP BY 1",
    "inner_by_id": "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "gold_loader": f"""SELECT gold_id, t AS text, label FROM (SELECT gold_id, regexp_replace({_strip("lower(coalesce(text, ''))")}, {_q(_S + '+')}, ' ', 'g') AS t,
  CASE lower(trim(sentiment)) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS label FROM gold) WHERE t <> '' AND label IS NOT NULL""",
    "augmented_training": """SELECT origin, y, count(*) AS n FROM (SELECT 'external' AS origin, y_toxic AS y FROM enriched_gold_labeled WHERE y_toxic IS NOT NULL AND key <> ''
  UNION ALL SELECT 'own', tox_toxic FROM gold WHERE split = 'train' AND text <> '' AND tox_toxic > 0) GROUP BY ALL""",
    "prefix_split": """SELECT CASE WHEN k <= floor(t * 0.05) THEN 'validation' ELSE 'train' END AS split, count(*) AS n, min(gold_id) AS least FROM (
  SELECT gold_id, row_number() OVER (ORDER BY md5('7:' || gold_id), gold_id) AS k, count(*) OVER () AS t FROM gold) GROUP BY 1""",
    "proposals_applied": f"""WITH t AS (SELECT key, {_alpha("coalesce(key, '')")} AS toks FROM enriched_gold_labeled),
i AS (SELECT * FROM t WHERE list_has_any(toks, {_list(STRONG_ID)}) OR (len(toks) >= 2 AND len(list_filter(toks, lambda t: list_contains({_list(STRONG_ID + WEAK_ID)}, t))) / len(toks) >= 0.3)),
p AS (SELECT key, CASE WHEN key IS NULL THEN 'no text' WHEN regexp_matches(lower(key), '\\bwkwk') THEN 'laughter' {" ".join(f"WHEN regexp_matches(lower(key), {_q('|'.join(parts))}) THEN '{reason}'" for _, _, reason, parts in PROPOSALS)}
  WHEN regexp_matches(lower(key), {_q(QUESTION_ID)}) THEN 'question' ELSE 'talk' END AS reason FROM i), f AS (SELECT text, min(lower(trim(sentiment))) AS c FROM gold WHERE text <> '' AND sentiment IS NOT NULL GROUP BY 1)
SELECT reason, CASE reason WHEN 'laughter' THEN coalesce(c, 'positive') {" ".join(f"WHEN '{reason}' THEN coalesce(c, '{'neutral' if conf == 'ASK' else label}')" for label, conf, reason, _ in PROPOSALS)} WHEN 'question' THEN 'neutral' WHEN 'talk' THEN 'neutral' END AS label, count(*) AS n
FROM p LEFT JOIN f ON f.text = p.key GROUP BY ALL""",
    "majority_vote": f"WITH v AS ({_SV}), {_MAJ} SELECT text, consensus, {_CONF} AS confidence, n_votes::BIGINT AS n_votes FROM mj",
    "consolidate": f"""WITH {_VOTES}, sv AS ({_SV}), {_MAJ.replace('FROM v', 'FROM sv')},
lt AS (SELECT label, text, value FROM (SELECT label, text, value, count(*) AS c, min(rater) AS first FROM v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label, text ORDER BY c DESC, first, value) = 1),
t AS (SELECT text, {", ".join(f"max(value) FILTER (WHERE label = '{x}') AS {x}" for x in TOX)} FROM lt GROUP BY text)
SELECT coalesce(mj.text, t.text) AS text, consensus AS sentiment, CASE WHEN mj.text IS NULL THEN 'missing' ELSE {_CONF} END AS confidence, n_votes::BIGINT AS n_votes, {", ".join(TOX)} FROM mj FULL JOIN t ON t.text = mj.text""",
    "stratified_allocation": _ALLOC.format(k="year, tier", t=2000, m=50, s="(SELECT * FROM processed WHERE year IS NOT NULL AND tier IS NOT NULL)"),
    "stratified_sample": "WITH g AS (SELECT * FROM gold WHERE year IS NOT NULL AND split IS NOT NULL), a AS (" + _ALLOC.format(k="year, split", t=200, m=5, s="g")
    + ") SELECT gold_id, year, split FROM (SELECT g.gold_id, g.year, g.split, alloc, row_number() OVER (PARTITION BY g.year, g.split ORDER BY md5('42:' || gold_id), gold_id) AS k FROM g JOIN a ON a.year = g.year AND a.split = g.split) WHERE k <= alloc",
    "train_test_split": """WITH g AS (SELECT gold_id, lower(trim(sentiment)) AS s FROM gold WHERE sentiment IS NOT NULL), c AS (SELECT s, count(*) AS n FROM g GROUP BY s),
e AS (SELECT s, n * ceil(sum(n) OVER () * 0.3) / sum(n) OVER () AS e, ceil(sum(n) OVER () * 0.3) AS t FROM c), f AS (SELECT *, floor(round(e, 9)) AS f FROM e),
h AS (SELECT s, f + (row_number() OVER (ORDER BY round(e - f, 9) DESC, s) <= t - sum(f) OVER ())::INT AS held FROM f)
SELECT gold_id, g.s, CASE WHEN row_number() OVER (PARTITION BY g.s ORDER BY md5('42:' || gold_id), gold_id) <= held THEN 'test' ELSE 'train' END AS split FROM g JOIN h ON h.s = g.s""",
    "validation_counts": "SELECT s, n FROM (SELECT lower(trim(sentiment)) AS s, round_even(count(*) * 0.1, 0)::BIGINT AS n FROM gold WHERE split = 'train' AND sentiment IS NOT NULL GROUP BY 1) WHERE n > 0",
    "quota_sample": """WITH g AS (SELECT idx, year, lex, coalesce(lex, false) AS f FROM enriched_gold_labeled WHERE year IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY year, f ORDER BY md5('42:' || idx), idx) AS k FROM g),
n AS (SELECT year, least(count(*) FILTER (WHERE f), 11) AS n FROM g GROUP BY 1) SELECT idx, r.year, lex FROM r JOIN n ON n.year = r.year WHERE CASE WHEN f THEN k <= 11 ELSE k <= 22 - n END""",
    "oversample_counts": "SELECT s, greatest(n, round_even(max(n) OVER () * 0.3, 0)::BIGINT) AS n FROM (SELECT lower(trim(sentiment)) AS s, count(*) AS n FROM gold WHERE sentiment IS NOT NULL GROUP BY 1)",
    "class_weights": """WITH c AS (SELECT l AS s, greatest(count(g.s), 1) AS n FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS l) LEFT JOIN (SELECT lower(trim(sentiment)) AS s FROM gold) g ON g.s = l GROUP BY l)
SELECT s, n, round(sum(n) OVER () / (3 * n), 6) AS weight FROM c""",
    "positive_weights": " UNION ALL ".join(f"SELECT '{l}' AS label, round(CASE WHEN sum(({l} > 0)::INT) > 0 THEN least(50, (count(*) - sum((coalesce({l}, 0) > 0)::INT)) / sum((coalesce({l}, 0) > 0)::INT)) ELSE 50 END, 6) AS weight FROM gold" for l in (f"tox_{x}" for x in TOX)),
    "bootstrap_ci": f"""WITH md AS (SELECT 'rules' AS model, lower(trim(sentiment)) AS sentiment, CASE WHEN category IN ('insult', 'ez_win', 'forfeit', 'obscene', 'gg_early') THEN 'negative' WHEN category IN ('laughter', 'sport', 'gg_end') THEN 'positive' ELSE 'neutral' END AS predicted
  FROM ({_rules_sql('gold')}) WHERE lower(trim(sentiment)) IN ('negative', 'neutral', 'positive')), {_MODELS[_MODELS.index('ce AS ('):]}{_MM}
SELECT metric, round(value, 6) AS value, true AS held FROM (UNPIVOT (SELECT accuracy, macro_f1, balanced_accuracy, mcc FROM mx) ON accuracy, macro_f1, balanced_accuracy, mcc INTO NAME metric VALUE value)""",
    "gold_pipeline": f"""WITH z AS (SELECT lower(trim(sentiment)) AS y, CASE WHEN category IN ('insult', 'ez_win', 'forfeit', 'obscene', 'gg_early') THEN 'negative' WHEN category IN ('laughter', 'sport', 'gg_end') THEN 'positive' ELSE 'neutral' END AS p
  FROM ({_rules_sql('gold')}) WHERE split = 'test' AND lower(trim(sentiment)) IN ('negative', 'neutral', 'positive')),
l AS (SELECT DISTINCT y AS l FROM z UNION SELECT DISTINCT p FROM z), r AS (SELECT l, coalesce(avg((y = p)::INT), 0) AS rec FROM l LEFT JOIN z ON z.y = l.l GROUP BY l)
SELECT 'rules' AS model, count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy, (SELECT round(avg(rec), 6) FROM r) AS macro_recall FROM z""",
    "candidate_pool": f"""WITH d AS (SELECT lower(key) AS low, year FROM enriched_gold_labeled WHERE key <> '' AND (regexp_matches(key, '{T.PROFANITY}') OR max_toxicity_prob >= 0.5)
  AND lower(key) NOT IN (SELECT lower(key) FROM gold WHERE key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lower(key) ORDER BY idx) = 1) SELECT year, count(*) AS n FROM d GROUP BY 1""",
}
