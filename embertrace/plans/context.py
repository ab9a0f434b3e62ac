"""Queries of the context functions and the join toolbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions import context as C
from embertrace.operators import joins as J
from embertrace.session import table

LABELS = ("negative", "neutral", "positive")
TOX = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """The labels of gold rows as a scorer's output: prob_* of three sentiments and of six kinds of toxicity, null where a row has none."""
    s = C.clean_sentiment(F.col("sentiment"))
    return table(spark, root, "gold").select(
        "gold_id", "match_id", "time", "player_slot", *[F.when(s.isNotNull(), (s == x).cast("double")).alias(f"prob_{x}") for x in LABELS],
        *[F.col(f"tox_{x}").cast("double").alias(f"prob_{x}") for x in TOX])


PREDICTIONS_SQL = f"""p AS (SELECT gold_id, match_id, time, player_slot, {", ".join(f"(lower(trim(sentiment)) = '{x}')::DOUBLE AS prob_{x}" for x in LABELS)},
  {", ".join(f"tox_{x}::DOUBLE AS prob_{x}" for x in TOX)} FROM gold)"""
ARGMAX_SQL = """CASE WHEN prob_negative IS NULL THEN NULL WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 'negative' WHEN prob_neutral >= prob_positive THEN 'neutral' ELSE 'positive' END"""
MOST_SQL = f"greatest({', '.join(f'prob_{x}' for x in TOX)})"


def tier_phase(spark: SparkSession, root: str) -> DataFrame:
    x = table(spark, root, "leagues").select("leagueid", "leaguename", "opendota_tier")
    return x.select("leagueid", C.tier(F.col("leaguename"), F.col("opendota_tier")).alias("tier"), C.phase(F.col("leaguename")).alias("phase"))


def outcome_minutes(spark: SparkSession, root: str) -> DataFrame:
    """Messages with their match: outcome, minute, calendar; counted by what they say."""
    chat = table(spark, root, "processed").select("match_id", "time", "player_slot")
    md = table(spark, root, "metadata").select("match_id", "start_date_time", "radiant_win", "duration")
    j = J.many_to_one(chat, md, ["match_id"])
    return j.groupBy(
        C.outcome(F.col("player_slot"), F.col("radiant_win")).alias("outcome"), F.floor(C.minute(F.col("time")) / 10).cast("long").alias("ten_minutes"),
        F.year("start_date_time").alias("year"), F.quarter("start_date_time").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(C.minute(F.col("time"))), 2).alias("minutes"))


def year_months(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("start_date_time", "year", "month")
    return p.select(C.year_month(F.col("start_date_time"), F.col("year"), F.col("month")).alias("year_month")).where("year_month IS NOT NULL").groupBy("year_month").agg(F.count(F.lit(1)).alias("n"))


def binned_counts(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("year", "duration")
    return p.groupBy(C.year_bin(F.col("year")).alias("years"), C.duration_bin(F.col("duration")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def prediction_flags(spark: SparkSession, root: str) -> DataFrame:
    p = predictions(spark, root).withColumn("predicted", C.argmax_label([(x, F.col(f"prob_{x}")) for x in LABELS]))
    most = F.greatest(*[f"prob_{x}" for x in TOX])
    return p.select("gold_id", "predicted", F.round(C.sentiment_score(F.col("prob_positive"), F.col("prob_negative"), F.col("predicted")), 6).alias("score"),
                    *[C.flag(F.col(f"prob_{x}")).alias(f"pred_{x}") for x in TOX], most.alias("max_prob"),
                    C.flag(most).alias("any_toxic"), F.when(F.coalesce(most, F.lit(0.0)) >= 0.5, "negative").otherwise("neutral").alias("zero_shot"))


def sanitized_labels(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold")
    flags = {f"tox_{t}": C.clean_binary(F.col(f"tox_{t}").cast("string")) for t in TOX}
    g = g.withColumns(flags)
    total = sum((F.col(c) for c in flags), F.lit(0))
    return g.select("gold_id", C.clean_sentiment(F.col("sentiment")).alias("sentiment"), *flags, (total > 0).alias("any_positive"))


def game_stages(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("time", "duration")
    return p.groupBy(C.game_stage(F.col("time"), F.col("duration")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def metadata_first(spark: SparkSession, root: str) -> DataFrame:
    return J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time", "duration", "radiant_win", "leagueid"), ["match_id"],
                        [F.col("start_date_time"), F.col("duration"), F.col("radiant_win"), F.col("leagueid")])


def join_many_to_one(spark: SparkSession, root: str) -> DataFrame:
    """Messages by whether their match is known, after a join that can't multiply rows."""
    chat = table(spark, root, "processed").select("match_id", "leagueid", "key")
    j = J.many_to_one(chat, table(spark, root, "metadata").select("match_id", "leagueid", F.lit(1).alias("known")), ["match_id"])
    return j.groupBy(F.col("known").isNotNull().alias("matched")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("n_matches"))


def dictionary_join(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("leagueid", "key")
    l = table(spark, root, "leagues").select("leagueid", "leaguename", "opendota_tier").withColumn("tier", C.tier(F.col("leaguename"), F.col("opendota_tier")))
    j = J.dictionary_join(p, l.withColumn("leaguename", F.lower(F.trim("leaguename"))), "leagueid", {"tier": C.OTHER, "leaguename": ""})
    return j.groupBy("tier", "leaguename").agg(F.count(F.lit(1)).alias("n"))


def asof_patch(spark: SparkSession, root: str) -> DataFrame:
    """Matches by the patch that began last before them; earlier ones get the first patch."""
    m = J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time"), ["match_id"])
    pts = table(spark, root, "patch_map").groupBy("date_start").agg(F.max("patch").alias("patch"))
    return J.asof_clip(m, pts, "start_date_time", "date_start", "patch", "patch_name").groupBy("patch_name").agg(F.count(F.lit(1)).alias("n"))


def interval_lead(spark: SparkSession, root: str) -> DataFrame:
    pts = table(spark, root, "patch_map").groupBy("date_start").agg(F.max("patch").alias("patch"))
    return J.interval_ends(pts, "date_start").select("patch", "date_start", "date_end")


def multi_key_join(spark: SparkSession, root: str) -> DataFrame:
    """Messages with the annotation of the same message key, both sides reduced to one row a key."""
    k = list(J.MESSAGE_KEY)
    p = J.keep_first(table(spark, root, "processed").select(*k, "key"), k, ["key"])
    g = J.keep_first(table(spark, root, "gold").select(*k, "gold_id", F.col("sentiment").alias("gold_sentiment")), k, ["gold_id"])
    return p.join(g, k, "left").agg(F.count(F.lit(1)).alias("n"), F.count("gold_id").alias("n_annotated"), F.count_distinct("gold_sentiment").alias("n_sentiments"))


def semi_prefilter(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").where("split = 'test'")
    p = J.semi_by_key(table(spark, root, "processed").select(*J.MESSAGE_KEY, "tier"), g, J.MESSAGE_KEY)
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def anti_join_gold(spark: SparkSession, root: str) -> DataFrame:
    p = J.anti_by_key(table(spark, root, "processed").select(*J.MESSAGE_KEY, "source_folder"), table(spark, root, "gold"), J.MESSAGE_KEY)
    return p.groupBy("source_folder").agg(F.count(F.lit(1)).alias("n"))


def split_leaks(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select("match_id", "time", "player_slot", "split")
    return J.leak_count(g.where("split = 'train'"), g.where("split = 'test'"), J.MESSAGE_KEY)


def key_set_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of union, intersection and differences of the match sets of two tables."""
    a, b = (table(spark, root, t).select("match_id").distinct() for t in ("gold", "metadata"))
    u = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "match_id", "full_outer")
    return u.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"),
                 F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b"))


def dedup_lower_text(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select(F.lower("key").alias("low"), "match_id", "time", "player_slot", "key").where("low IS NOT NULL")
    return J.keep_first(p, ["low"], ["match_id", "time", "player_slot", "key"])


QUERIES = {f.__name__: f for f in (
    tier_phase, outcome_minutes, year_months, binned_counts, prediction_flags, sanitized_labels, game_stages, metadata_first, join_many_to_one, dictionary_join,
    asof_patch, interval_lead, multi_key_join, semi_prefilter, anti_join_gold, split_leaks, key_set_sizes, dedup_lower_text)}

TIER_SQL = """CASE WHEN lower(trim(coalesce(opendota_tier, ''))) IN ('excluded', 'amateur', '') THEN 'Lainnya'
  WHEN lower(coalesce(leaguename, '')) LIKE '%qualif%' THEN 'Lainnya'
  WHEN regexp_matches(trim(coalesce(leaguename, '')), '(?i)\\bthe international\\b') THEN CASE WHEN regexp_matches(trim(leaguename), '(?i)\\bthe international\\s+([1-9]|[0-9]{2,4})\\b')
    OR regexp_matches(leaguename, 'International [0-9]') THEN 'TI' ELSE 'Lainnya' END
  WHEN regexp_matches(coalesce(leaguename, ''), '(?i)\\bmajor\\b') THEN 'Major'
  WHEN regexp_matches(coalesce(leaguename, ''), '(?i)(\\bdpc\\b|dota pro circuit|\\btour [1-3]\\b)') THEN 'DPC Tour' ELSE 'Lainnya' END"""
_FIRST = "(SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start_date_time NULLS LAST, duration NULLS LAST, radiant_win NULLS LAST, leagueid NULLS LAST) AS k FROM metadata)"
_MINUTE = "round_even(time / 60, 2)"
_MSG = "match_id, time, player_slot"
ORACLES = {
    "tier_phase": f"""SELECT leagueid, {TIER_SQL} AS tier, CASE WHEN regexp_matches(coalesce(leaguename, ''), '(?i)grand final') THEN 'grand_final'
  WHEN regexp_matches(coalesce(leaguename, ''), '(?i)\\bfinals?\\b') THEN 'playoffs' WHEN lower(leaguename) LIKE '%playoff%' THEN 'playoffs'
  WHEN regexp_matches(coalesce(leaguename, ''), '(?i)group stage') THEN 'group_stage' ELSE 'lainnya' END AS phase FROM leagues""",
    "outcome_minutes": f"""WITH m AS (SELECT match_id, start_date_time, radiant_win FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start_date_time NULLS LAST, radiant_win NULLS LAST, duration NULLS LAST) AS k FROM metadata) WHERE k = 1)
SELECT CASE WHEN player_slot IS NULL OR radiant_win IS NULL THEN 'unknown' WHEN (player_slot < 128) = radiant_win THEN 'win' ELSE 'loss' END AS outcome,
  floor({_MINUTE} / 10)::BIGINT AS ten_minutes, year(m.start_date_time)::INT AS year, quarter(m.start_date_time)::INT AS quarter, count(*) AS n, round(sum({_MINUTE}), 2) AS minutes
FROM (SELECT match_id, time, player_slot FROM processed) p LEFT JOIN m ON m.match_id = p.match_id GROUP BY 1, 2, 3, 4""",
    "year_months": """SELECT ym AS year_month, count(*) AS n FROM (SELECT coalesce(strftime(start_date_time, '%Y-%m'), year::VARCHAR || '-' || lpad(month::VARCHAR, 2, '0')) AS ym FROM processed)
WHERE ym IS NOT NULL GROUP BY 1""",
    "binned_counts": """SELECT CASE WHEN year > 2015 AND year <= 2018 THEN '2016-2018' WHEN year > 2018 AND year <= 2021 THEN '2019-2021' WHEN year > 2021 AND year <= 2026 THEN '2022-2026' END AS years,
  CASE WHEN duration > 0 AND duration <= 1800 THEN 'short' WHEN duration > 1800 AND duration <= 2700 THEN 'medium' WHEN duration > 2700 AND duration <= 7200 THEN 'long' END AS length, count(*) AS n FROM processed GROUP BY 1, 2""",
    "prediction_flags": f"""WITH {PREDICTIONS_SQL} SELECT gold_id, {ARGMAX_SQL} AS predicted, round(prob_positive - prob_negative, 6) AS score,
  {", ".join(f"coalesce((prob_{x} >= 0.5)::INT, 0) AS pred_{x}" for x in TOX)}, {MOST_SQL} AS max_prob, coalesce(({MOST_SQL} >= 0.5)::INT, 0) AS any_toxic,
  CASE WHEN coalesce({MOST_SQL}, 0) >= 0.5 THEN 'negative' ELSE 'neutral' END AS zero_shot FROM p""",
    "sanitized_labels": "SELECT gold_id, lower(trim(sentiment)) AS sentiment, " + ", ".join(f"least(greatest(coalesce(tox_{t}, 0), 0), 1) AS tox_{t}" for t in TOX)
    + ", " + " + ".join(f"least(greatest(coalesce(tox_{t}, 0), 0), 1)" for t in TOX) + " > 0 AS any_positive FROM gold",
    "game_stages": """SELECT CASE WHEN time / nullif(duration, 0) IS NULL THEN 'unknown' WHEN time < 0 THEN 'before' WHEN time / duration >= 0.95 THEN 'end' WHEN time / duration >= 0.85 THEN 'late' ELSE 'play' END AS stage, count(*) AS n FROM processed GROUP BY 1""",
    "metadata_first": f"SELECT match_id, start_date_time, duration, radiant_win, leagueid FROM {_FIRST} WHERE k = 1",
    "join_many_to_one": "SELECT m.match_id IS NOT NULL AS matched, count(*) AS n, count(DISTINCT p.match_id) AS n_matches FROM processed p LEFT JOIN (SELECT DISTINCT match_id FROM metadata) m ON m.match_id = p.match_id GROUP BY 1",
    "dictionary_join": f"""WITH l AS (SELECT leagueid, tier, leaguename FROM (SELECT leagueid, {TIER_SQL} AS tier, lower(trim(leaguename)) AS leaguename FROM leagues) QUALIFY row_number() OVER (PARTITION BY leagueid ORDER BY tier NULLS LAST, leaguename NULLS LAST) = 1)
SELECT coalesce(l.tier, 'Lainnya') AS tier, coalesce(l.leaguename, '') AS leaguename, count(*) AS n FROM (SELECT leagueid FROM processed) p LEFT JOIN l ON l.leagueid = p.leagueid GROUP BY 1, 2""",
    "asof_patch": """WITH s AS (SELECT date_start, max(patch) AS patch FROM patch_map WHERE date_start IS NOT NULL GROUP BY 1), m AS (SELECT match_id, min(start_date_time) AS st FROM metadata GROUP BY 1)
SELECT patch_name, count(*) AS n FROM (SELECT CASE WHEN st IS NULL THEN NULL ELSE coalesce((SELECT arg_max(patch, date_start) FROM s WHERE date_start <= st), (SELECT arg_min(patch, date_start) FROM s)) END AS patch_name FROM m) GROUP BY 1""",
    "interval_lead": "WITH s AS (SELECT date_start, max(patch) AS patch FROM patch_map GROUP BY 1) SELECT patch, date_start, coalesce(lead(date_start) OVER (ORDER BY date_start) - INTERVAL 1 SECOND, TIMESTAMP '2099-12-31') AS date_end FROM s",
    "multi_key_join": f"""WITH p AS (SELECT DISTINCT {_MSG} FROM processed), g AS (SELECT {_MSG}, min(gold_id) AS gold_id, arg_min(coalesce(sentiment, '~'), gold_id) AS s FROM gold GROUP BY ALL)
SELECT count(*) AS n, count(g.gold_id) AS n_annotated, count(DISTINCT nullif(g.s, '~')) AS n_sentiments FROM p LEFT JOIN g ON g.match_id = p.match_id AND g.time = p.time AND g.player_slot = p.player_slot""",
    "semi_prefilter": f"SELECT tier, count(*) AS n FROM processed p WHERE EXISTS (SELECT 1 FROM gold g WHERE g.split = 'test' AND g.match_id = p.match_id AND g.time = p.time AND g.player_slot = p.player_slot) GROUP BY 1",
    "anti_join_gold": "SELECT source_folder, count(*) AS n FROM processed p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.match_id = p.match_id AND g.time = p.time AND g.player_slot = p.player_slot) GROUP BY 1",
    "split_leaks": f"SELECT count(*) AS n_common FROM (SELECT {_MSG} FROM gold WHERE split = 'train' AND match_id IS NOT NULL AND time IS NOT NULL AND player_slot IS NOT NULL INTERSECT SELECT {_MSG} FROM gold WHERE split = 'test')",
    "key_set_sizes": """WITH a AS (SELECT DISTINCT match_id FROM gold), b AS (SELECT DISTINCT match_id FROM metadata)
SELECT count(*) AS n_union, count(*) FILTER (WHERE a.match_id IS NOT NULL AND b.match_id IS NOT NULL) AS n_common, count(*) FILTER (WHERE b.match_id IS NULL) AS n_only_a, count(*) FILTER (WHERE a.match_id IS NULL) AS n_only_b
FROM a FULL JOIN b ON a.match_id = b.match_id""",
    "dedup_lower_text": """SELECT lower(key) AS low, match_id, time, player_slot, key FROM processed WHERE key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lower(key) ORDER BY match_id NULLS LAST, time NULLS LAST, player_slot NULLS LAST, key) = 1""",
}
