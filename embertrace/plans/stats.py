"""Queries of series, contingency tables and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.functions import context as C
from embertrace.operators import joins as J
from embertrace.operators import series as A
from embertrace.operators import stats as S
from embertrace.plans.context import ARGMAX_SQL, LABELS, MOST_SQL, PREDICTIONS_SQL, TOX, predictions
from embertrace.session import table

ERAS = (("early", "2016-01-01", "2018-12-31"), ("middle", "2019-01-01", "2021-12-31"), ("late", "2022-01-01", "2026-12-31"))


def merged(spark: SparkSession, root: str) -> DataFrame:
    """Messages with the predictions of their key, both reduced to one row a key."""
    k = list(J.MESSAGE_KEY)
    p = J.keep_first(table(spark, root, "processed").select(*k, "start_date_time", "year", "tier", "duration", "phase"), k, ["start_date_time", "year", "tier", "duration", "phase"])
    q = J.keep_first(predictions(spark, root), k, ["gold_id"])
    j = p.join(q.drop("gold_id"), k, "left")
    j = j.withColumn("predicted", C.argmax_label([(x, F.col(f"prob_{x}")) for x in LABELS]))
    return j.withColumns({"score": C.sentiment_score(F.col("prob_positive"), F.col("prob_negative"), F.col("predicted")), **{x: C.flag(F.col(f"prob_{x}")) for x in TOX},
                          "max_prob": F.greatest(*[f"prob_{x}" for x in TOX])})


MERGED_SQL = f"""{PREDICTIONS_SQL},
pm AS (SELECT match_id, time, player_slot, start_date_time, year, tier, duration, phase FROM processed
  QUALIFY row_number() OVER (PARTITION BY match_id, time, player_slot ORDER BY start_date_time NULLS LAST, year NULLS LAST, tier NULLS LAST, duration NULLS LAST, phase NULLS LAST) = 1),
pq AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match_id, time, player_slot ORDER BY gold_id) = 1),
j AS (SELECT pm.*, {ARGMAX_SQL} AS predicted, prob_positive - prob_negative AS score, {", ".join(f"coalesce((prob_{x} >= 0.5)::INT, 0) AS {x}" for x in TOX)}, {MOST_SQL} AS max_prob
  FROM pm LEFT JOIN pq ON pq.match_id = pm.match_id AND pq.time = pm.time AND pq.player_slot = pm.player_slot)"""
_METRICS = f"""count(*) AS n_messages, count(DISTINCT match_id) AS n_matches, {", ".join(f"round(avg(CASE WHEN predicted = '{x}' THEN 1.0 ELSE 0 END), 6) AS pct_{x}" for x in LABELS)},
  round(avg(score), 4) AS mean_sentiment_score, round(avg(CASE WHEN {" + ".join(TOX)} > 0 THEN 1.0 ELSE 0 END), 6) AS pct_toxic_any, round(avg(coalesce(max_prob, 0)), 4) AS mean_toxicity_score,
  {", ".join(f"round(avg({x}), 6) AS pct_{x}" for x in TOX)}"""


def _series(spark, root, key, name):
    return A.label_series(merged(spark, root), key, name, "match_id", "predicted", "score", LABELS, "max_prob", TOX)


def monthly_series(spark: SparkSession, root: str) -> DataFrame:
    return _series(spark, root, C.year_month(F.col("start_date_time")), "year_month")


def yearly_series(spark: SparkSession, root: str) -> DataFrame:
    return _series(spark, root, F.year("start_date_time"), "period_year")


def _month_counts(spark, root):
    m = J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time"), ["match_id"])
    return m.select(C.year_month(F.col("start_date_time")).alias("year_month")).where("year_month IS NOT NULL").groupBy("year_month").agg(F.count(F.lit(1)).alias("n"))


def series_gap_fill(spark: SparkSession, root: str) -> DataFrame:
    """Annotations of each source by month, with its empty months as null rows."""
    p = table(spark, root, "gold").select(F.coalesce("source", F.lit("none")).alias("source"), C.year_month(F.lit(None).cast("timestamp_ntz"), F.col("year"), F.col("month")).alias("year_month")).where("year_month IS NOT NULL")
    return A.fill_gaps(p.groupBy("source", "year_month").agg(F.count(F.lit(1)).alias("n")), "year_month", ["source"])


def per_match(spark: SparkSession, root: str) -> DataFrame:
    """Per match: means, count, and the first non-null context."""
    m = merged(spark, root).where("match_id IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("time", "player_slot", c)))
    return m.groupBy("match_id").agg(F.round(F.avg(F.coalesce("max_prob", F.lit(0.0))), 6).alias("mean_toxicity"), F.round(F.avg("score"), 6).alias("mean_sentiment"),
                                     F.count(F.lit(1)).alias("n"), first("duration").alias("duration"), first("tier").alias("tier"), first("phase").alias("phase"))


def year_rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "processed").select("year", "month").rollup("year", "month").agg(F.count(F.lit(1)).alias("n"))


def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return A.value_counts(table(spark, root, "processed").select("tier", "phase"), ["tier", "phase"])


def crosstab(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select(F.coalesce("tier", F.lit("none")).alias("tier"), C.clean_sentiment(F.col("sentiment")).alias("s"))
    return g.groupBy("tier").pivot("s", ["negative", "neutral", "positive"]).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_normalized(spark: SparkSession, root: str) -> DataFrame:
    return A.row_shares(table(spark, root, "processed").select("tier", "match_outcome_for_player"), "tier", "match_outcome_for_player")


def top_languages(spark: SparkSession, root: str) -> DataFrame:
    return A.top_shares(table(spark, root, "processed").select("lang"), "lang", 8)


def corpus_profile(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("year", "tier", "lang", "match_id")
    return p.groupBy("year", "tier", (F.col("lang") == "en").alias("english")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("n_matches"))


def label_prevalence(spark: SparkSession, root: str) -> DataFrame:
    """Positives and prevalence of each label, in long form."""
    labels = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
    g = table(spark, root, "gold").select(*[F.col(f"tox_{x}").cast("int").alias(x) for x in labels]).unpivot([], list(labels), "label", "v")
    return g.groupBy("label").agg(F.sum(F.coalesce("v", F.lit(0))).cast("long").alias("positives"), F.round(F.avg(F.coalesce("v", F.lit(0)).cast("double")), 6).alias("prevalence"))


def box_inputs(spark: SparkSession, root: str) -> DataFrame:
    return A.five_numbers(table(spark, root, "metadata").select("patch", "duration"), "patch", "duration")


def midrank(spark: SparkSession, root: str) -> DataFrame:
    return S.midranks(table(spark, root, "metadata").select("duration"), "duration")


def _durations(spark, root):
    return table(spark, root, "metadata").select("radiant_win", "duration", "patch", "first_blood_time", "region")


def mann_whitney(spark: SparkSession, root: str) -> DataFrame:
    d = S.mann_whitney(_durations(spark, root), "radiant_win", "duration")
    return d.select("n_a", "n_b", F.round("u", 3).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"), F.round("z", 6).alias("z"))


def kruskal_wallis(spark: SparkSession, root: str) -> DataFrame:
    return S.kruskal(_durations(spark, root), "patch", "duration").select("k", "n", F.round("h", 6).alias("h"), F.round("epsilon_squared", 6).alias("epsilon_squared"))


def dunn_pairs(spark: SparkSession, root: str) -> DataFrame:
    d = S.pairwise(_durations(spark, root), "patch", "duration")
    return d.select("group_a", "group_b", "n_a", "n_b", F.round("u", 3).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"))


def spearman(spark: SparkSession, root: str) -> DataFrame:
    return S.spearman(_durations(spark, root), "duration", "first_blood_time").select("n", F.round("rho", 6).alias("rho"))


def chi_square(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("tier", "match_outcome_for_player")
    return S.chi_square(p, "tier", "match_outcome_for_player").select("n", "dof", F.round("chi2", 5).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"))


def era_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Means, counts and matches of the eras; both ends count at midnight."""
    m = J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time", "duration"), ["match_id"], ["start_date_time", "duration"])
    cols = []
    for name, a, b in ERAS:
        inside = F.col("start_date_time").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
        cols += [F.count_if(inside & F.col("duration").isNotNull()).alias(f"n_{name}"), F.round(F.avg(F.when(inside, F.col("duration"))), 6).alias(f"mean_{name}"),
                 F.count_distinct(F.when(inside, F.col("match_id"))).alias(f"matches_{name}")]
    return m.agg(*cols)


def era_tests(spark: SparkSession, root: str) -> DataFrame:
    """Mann-Whitney of durations for each pair of eras (with p values; no SQL twin)."""
    m = J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time", "duration"), ["match_id"], ["start_date_time", "duration"])
    era = F.lit(None).cast("string")
    for name, a, b in ERAS:
        era = F.when(F.col("start_date_time").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), name).otherwise(era)
    return S.pairwise(m.withColumn("era", era), "era", "duration", least=31)


def _series_long(spark, root):
    d = J.keep_first(table(spark, root, "metadata").select("match_id", "start_date_time", "duration"), ["match_id"], ["start_date_time", "duration"])
    d = d.select(C.year_month(F.col("start_date_time")).alias("year_month"), "duration").where("year_month IS NOT NULL").groupBy("year_month").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("v"))
    m = d.withColumn("i", F.row_number().over(Window.orderBy("year_month")) - 1)  # a row a month
    return m.select("i", F.lit("matches").alias("series"), F.col("n").cast("double").alias("v")).unionByName(m.select("i", F.lit("duration").alias("series"), F.round("v", 6).alias("v")).where("v IS NOT NULL"))


_LONG_SQL = """m AS (SELECT ym, count(*) AS n, avg(duration) AS d FROM (SELECT strftime(start_date_time, '%Y-%m') AS ym, duration FROM metadata
    QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY start_date_time NULLS LAST, duration NULLS LAST) = 1) WHERE ym IS NOT NULL GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY ym) - 1 AS i FROM m), l AS (SELECT i, 'matches' AS series, n::DOUBLE AS v FROM x UNION ALL SELECT i, 'duration', round(d, 6) FROM x WHERE d IS NOT NULL)"""


def mann_kendall(spark: SparkSession, root: str) -> DataFrame:
    return S.mann_kendall(_series_long(spark, root), "series", "i", "v").select("series", "n", F.round("tau", 6).alias("tau"), F.round("z", 6).alias("z"))


def chow(spark: SparkSession, root: str) -> DataFrame:
    l = _series_long(spark, root)
    out = S.chow(l, "series", "i", "v", 20).unionByName(S.chow(l, "series", "i", "v", 50))
    return out.select("series", "breakpoint", "n", F.round("f_statistic", 5).alias("f_statistic"))


def test_rows(spark: SparkSession, root: str) -> DataFrame:
    """Trend and break tests together: unlike schemas united by name."""
    l = _series_long(spark, root)
    return S.mann_kendall(l, "series", "i", "v").unionByName(S.chow(l, "series", "i", "v", 50), allowMissingColumns=True)


def bh_fdr(spark: SparkSession, root: str) -> DataFrame:
    """Benjamini-Hochberg over goodness-of-fit tests by month: do the three outcomes have their overall shares?  (2 degrees: p = exp(-chi2 / 2).)"""
    names = ("win", "loss", "unknown")
    p = table(spark, root, "processed").select("year", "month", "match_outcome_for_player").where("year IS NOT NULL AND month IS NOT NULL")
    c = p.groupBy("year", "month").agg(*[F.count_if(F.col("match_outcome_for_player") == x).cast("double").alias(x) for x in names])
    all_n = Window.partitionBy(F.lit(1))  # a row a month
    n, total = F.col("win") + F.col("loss") + F.col("unknown"), sum((F.sum(x).over(all_n) for x in names), F.lit(0.0))
    e = {x: n * F.sum(x).over(all_n) / total for x in names}
    chi2 = sum((F.when(e[x] > 0, (F.col(x) - e[x]) ** 2 / e[x]).otherwise(0.0) for x in names), F.lit(0.0))
    d = S.benjamini_hochberg(c.select("year", "month", F.exp(-chi2 / 2).alias("p")), "p", 0.25)
    return d.select("year", "month", F.round("p", 9).alias("p"), F.round("p_adj_bh", 9).alias("p_adj_bh"), "significant_bh")


def nearest_month(spark: SparkSession, root: str) -> DataFrame:
    """For each patch start the index of the month nearest to it."""
    m = _month_counts(spark, root).withColumn("i", F.row_number().over(Window.orderBy("year_month")) - 1)
    months = F.array_sort(F.collect_list(F.struct("i", F.to_date(F.concat("year_month", F.lit("-01"))).alias("d"))))
    e = table(spark, root, "patch_map").select("patch", "date_start").distinct()
    x = e.withColumn("ms", m.agg(months.alias("ms")).scalar())  # at most a few hundred months
    gap = F.transform("ms", lambda y: F.struct(F.abs(F.datediff(y["d"], F.col("date_start").cast("date"))).alias("gap"), y["i"].alias("i")))
    return x.select("patch", "date_start", F.array_min(gap)["i"].alias("i"))


def correlation_suite(spark: SparkSession, root: str) -> DataFrame:
    """Tests of context against outcome with adjusted p values and absolute effects (no SQL twin)."""
    p, d = table(spark, root, "processed"), _durations(spark, root)
    rows = [
        S.chi_square(p, "tier", "match_outcome_for_player").select(F.lit("chi2 tier x outcome").alias("test"), "n", F.col("chi2").alias("statistic"), F.col("cramers_v").alias("effect"), "p_value"),
        S.chi_square(p, "phase", "match_outcome_for_player").select(F.lit("chi2 phase x outcome").alias("test"), "n", F.col("chi2").alias("statistic"), F.col("cramers_v").alias("effect"), "p_value"),
        S.kruskal(d, "patch", "duration").select(F.lit("kruskal duration by patch").alias("test"), "n", F.col("h").alias("statistic"), F.col("epsilon_squared").alias("effect"), "p_value"),
        S.mann_whitney(d, "radiant_win", "duration").select(F.lit("mann-whitney duration by win").alias("test"), (F.col("n_a") + F.col("n_b")).alias("n"), F.col("u").alias("statistic"), F.col("rank_biserial").alias("effect"), "p_value"),
        S.spearman(d, "duration", "first_blood_time").select(F.lit("spearman duration x first blood").alias("test"), "n", F.col("rho").alias("statistic"), F.col("rho").alias("effect"), "p_value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return S.benjamini_hochberg(out, "p_value").orderBy(F.abs("effect").desc())


QUERIES = {f.__name__: f for f in (
    monthly_series, yearly_series, series_gap_fill, per_match, year_rollup, value_counts, crosstab, crosstab_normalized, top_languages, corpus_profile, label_prevalence, box_inputs,
    midrank, mann_whitney, kruskal_wallis, dunn_pairs, spearman, chi_square, era_comparison, era_tests, mann_kendall, chow, test_rows, bh_fdr, nearest_month, correlation_suite)}

_RANKS = """r AS (SELECT v, count(*) AS c FROM d GROUP BY v), k AS (SELECT v, c, sum(c) OVER (ORDER BY v) - c + (c + 1) / 2.0 AS rk FROM r)"""


def _pairs_sql(d: str, least: int) -> str:
    return f"""d AS ({d}), ok AS (SELECT g FROM d GROUP BY g HAVING count(*) >= {least}), c AS (SELECT g, v, count(*)::DOUBLE AS n FROM d WHERE g IN (SELECT g FROM ok) GROUP BY g, v),
pr AS (SELECT a.g AS ga, b.g AS gb, sum(CASE WHEN b.v < a.v THEN a.n * b.n WHEN b.v = a.v THEN a.n * b.n / 2 ELSE 0 END) AS u FROM c a JOIN c b ON a.g < b.g GROUP BY 1, 2),
s AS (SELECT g, sum(n) AS n FROM c GROUP BY g), tt AS (SELECT ga, gb, sum(t * t * t - t) AS ties FROM (SELECT pr.ga, pr.gb, c.v, sum(c.n) AS t FROM pr JOIN c ON c.g IN (pr.ga, pr.gb) GROUP BY ALL) GROUP BY 1, 2)"""


ORACLES = {
    "monthly_series": f"WITH {MERGED_SQL} SELECT strftime(start_date_time, '%Y-%m') AS year_month, {_METRICS} FROM j WHERE start_date_time IS NOT NULL GROUP BY 1",
    "yearly_series": f"WITH {MERGED_SQL} SELECT year(start_date_time)::INT AS period_year, {_METRICS} FROM j WHERE start_date_time IS NOT NULL GROUP BY 1",
    "series_gap_fill": """WITH s AS (SELECT coalesce(source, 'none') AS source, year::VARCHAR || '-' || lpad(month::VARCHAR, 2, '0') AS ym, count(*) AS n FROM gold WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2),
g AS (SELECT source, strftime(d, '%Y-%m') AS ym FROM (SELECT source, unnest(generate_series(min(ym || '-01')::TIMESTAMP, max(ym || '-01')::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM s GROUP BY source))
SELECT g.source, g.ym AS year_month, s.n FROM g LEFT JOIN s ON s.ym = g.ym AND s.source = g.source""",
    "per_match": f"""WITH {MERGED_SQL} SELECT match_id, round(avg(coalesce(max_prob, 0)), 6) AS mean_toxicity, round(avg(score), 6) AS mean_sentiment, count(*) AS n,
  first(phase ORDER BY time NULLS FIRST, player_slot NULLS FIRST, phase) FILTER (WHERE phase IS NOT NULL) AS phase,
  first(duration ORDER BY time NULLS FIRST, player_slot NULLS FIRST, duration) FILTER (WHERE duration IS NOT NULL) AS duration, first(tier ORDER BY time NULLS FIRST, player_slot NULLS FIRST, tier) FILTER (WHERE tier IS NOT NULL) AS tier
FROM j WHERE match_id IS NOT NULL GROUP BY match_id""",
    "year_rollup": "SELECT year, month, count(*) AS n FROM processed GROUP BY ROLLUP (year, month)",
    "value_counts": "SELECT tier, phase, count(*) AS n FROM processed GROUP BY ALL",
    "crosstab": """SELECT coalesce(tier, 'none') AS tier, count(*) FILTER (WHERE lower(trim(sentiment)) = 'negative') AS negative, count(*) FILTER (WHERE lower(trim(sentiment)) = 'neutral') AS neutral,
  count(*) FILTER (WHERE lower(trim(sentiment)) = 'positive') AS positive FROM gold GROUP BY 1""",
    "crosstab_normalized": "SELECT tier, match_outcome_for_player, n, round(n / sum(n) OVER (PARTITION BY tier), 6) AS share FROM (SELECT tier, match_outcome_for_player, count(*) AS n FROM processed WHERE tier IS NOT NULL AND match_outcome_for_player IS NOT NULL GROUP BY ALL)",
    "top_languages": "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM processed), 6) AS share FROM processed GROUP BY lang ORDER BY n DESC, lang NULLS FIRST LIMIT 8",
    "corpus_profile": "SELECT year, tier, lang = 'en' AS english, count(*) AS n, count(DISTINCT match_id) AS n_matches FROM processed GROUP BY ALL",
    "label_prevalence": " UNION ALL ".join(f"SELECT '{x}' AS label, sum(coalesce(tox_{x}, 0))::BIGINT AS positives, round(avg(coalesce(tox_{x}, 0)), 6) AS prevalence FROM gold" for x in ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")),
    "box_inputs": """SELECT patch, count(*) AS n, round(q[1], 6) AS least, round(q[2], 6) AS q1, round(q[3], 6) AS median, round(q[4], 6) AS q3, round(q[5], 6) AS most FROM (
  SELECT patch, duration, quantile_cont(duration::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) OVER (PARTITION BY patch) AS q FROM metadata WHERE patch IS NOT NULL AND duration IS NOT NULL) GROUP BY patch, q""",
    "midrank": f"WITH d AS (SELECT duration AS v FROM metadata WHERE duration IS NOT NULL), {_RANKS} SELECT v AS duration, c AS n, rk AS midrank FROM k",
    "mann_whitney": f"""WITH {_pairs_sql("SELECT radiant_win AS g, duration::DOUBLE AS v FROM metadata WHERE radiant_win IS NOT NULL AND duration IS NOT NULL", 5)},
f AS (SELECT a.n AS n1, b.n AS n2, u, ties, a.n + b.n AS n FROM pr JOIN s a ON a.g = ga JOIN s b ON b.g = gb JOIN tt ON tt.ga = pr.ga AND tt.gb = pr.gb)
SELECT n1::BIGINT AS n_a, n2::BIGINT AS n_b, round(u, 3) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial,
  round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM f""",
    "kruskal_wallis": f"""WITH d0 AS (SELECT patch AS g, duration::DOUBLE AS v FROM metadata WHERE patch IS NOT NULL AND duration IS NOT NULL),
d AS (SELECT * FROM d0 WHERE g IN (SELECT g FROM d0 GROUP BY g HAVING count(*) >= 5)), {_RANKS},
g AS (SELECT g, count(*)::DOUBLE AS m, sum(rk) AS r FROM d JOIN k ON k.v = d.v GROUP BY g), t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties, sum(c)::DOUBLE AS n FROM r),
h AS (SELECT (SELECT count(*) FROM g) AS k, n, (12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM g) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM t)
SELECT k::INT AS k, n::BIGINT AS n, round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS epsilon_squared FROM h""",
    "dunn_pairs": f"""WITH {_pairs_sql("SELECT patch AS g, duration::DOUBLE AS v FROM metadata WHERE patch IS NOT NULL AND duration IS NOT NULL", 5)}
SELECT ga::VARCHAR AS group_a, gb::VARCHAR AS group_b, a.n::BIGINT AS n_a, b.n::BIGINT AS n_b, round(u, 3) AS u, round(1 - 2 * u / (a.n * b.n), 6) AS rank_biserial FROM pr JOIN s a ON a.g = ga JOIN s b ON b.g = gb""",
    "spearman": """WITH d AS (SELECT duration::DOUBLE AS x, first_blood_time AS y FROM metadata WHERE duration IS NOT NULL AND first_blood_time IS NOT NULL AND NOT isnan(first_blood_time)),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""",
    "chi_square": """WITH c AS (SELECT tier AS a, match_outcome_for_player AS b, count(*)::DOUBLE AS o FROM processed WHERE tier IS NOT NULL AND match_outcome_for_player IS NOT NULL GROUP BY ALL),
r AS (SELECT a, sum(o) AS s FROM c GROUP BY a), k AS (SELECT b, sum(o) AS s FROM c GROUP BY b), n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT coalesce(c.o, 0) AS o, r.s * k.s / n.n AS e FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b),
x AS (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM g), z AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk)
SELECT n.n::BIGINT AS n, (nr - 1) * (nk - 1) AS dof, round(chi2, 5) AS chi2, round(sqrt(chi2 / (n.n * (least(nr, nk) - 1))), 6) AS cramers_v FROM x, z, n""",
    "era_comparison": "WITH m AS (SELECT match_id, start_date_time AS st, duration FROM metadata QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY start_date_time NULLS LAST, duration NULLS LAST) = 1) SELECT "
    + ", ".join(f"count(duration) FILTER (WHERE st BETWEEN '{a}' AND '{b}') AS n_{e}, round(avg(duration) FILTER (WHERE st BETWEEN '{a}' AND '{b}'), 6) AS mean_{e}, count(DISTINCT match_id) FILTER (WHERE st BETWEEN '{a}' AND '{b}') AS matches_{e}" for e, a, b in ERAS) + " FROM m",
    "mann_kendall": f"""WITH {_LONG_SQL}, s AS (SELECT a.series, sum(sign(b.v - a.v))::DOUBLE AS s FROM l a JOIN l b ON a.series = b.series AND a.i < b.i GROUP BY 1), c AS (SELECT series, count(*)::DOUBLE AS n FROM l GROUP BY 1)
SELECT series, n::INT AS n, round(s / (n * (n - 1) / 2), 6) AS tau, round((s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18), 6) AS z FROM s JOIN c USING (series)""",
    "chow": f"WITH {_LONG_SQL}, " + "s AS (" + " UNION ALL ".join(
        f"""SELECT series, {b} AS breakpoint, count(*) AS n, regr_syy(v, i) - regr_sxy(v, i) ^ 2 / regr_sxx(v, i) AS s,
  regr_syy(v, i) FILTER (WHERE i < {b}) - (regr_sxy(v, i) FILTER (WHERE i < {b})) ^ 2 / (regr_sxx(v, i) FILTER (WHERE i < {b})) AS s1,
  regr_syy(v, i) FILTER (WHERE i >= {b}) - (regr_sxy(v, i) FILTER (WHERE i >= {b})) ^ 2 / (regr_sxx(v, i) FILTER (WHERE i >= {b})) AS s2 FROM l GROUP BY series""" for b in (20, 50))
    + ") SELECT series, breakpoint, n, round(((s - s1 - s2) / 2) / ((s1 + s2) / (n - 4)), 5) AS f_statistic FROM s",
    "bh_fdr": """WITH c AS (SELECT year, month, count(*) FILTER (WHERE match_outcome_for_player = 'win')::DOUBLE AS w, count(*) FILTER (WHERE match_outcome_for_player = 'loss')::DOUBLE AS l,
  count(*) FILTER (WHERE match_outcome_for_player = 'unknown')::DOUBLE AS u FROM processed WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY ALL),
o AS (SELECT sum(w) AS w, sum(l) AS l, sum(u) AS u, sum(w + l + u) AS n FROM c),
e AS (SELECT c.*, (c.w + c.l + c.u) * o.w / o.n AS ew, (c.w + c.l + c.u) * o.l / o.n AS el, (c.w + c.l + c.u) * o.u / o.n AS eu FROM c, o),
t AS (SELECT year, month, exp(-(CASE WHEN ew > 0 THEN (w - ew) ^ 2 / ew ELSE 0 END + CASE WHEN el > 0 THEN (l - el) ^ 2 / el ELSE 0 END + CASE WHEN eu > 0 THEN (u - eu) ^ 2 / eu ELSE 0 END) / 2) AS p FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t),
a AS (SELECT *, min(least(1.0, p * m / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj FROM r)
SELECT year, month, round(p, 9) AS p, round(adj, 9) AS p_adj_bh, adj <= 0.25 AS significant_bh FROM a""",
    "nearest_month": f"""WITH {_LONG_SQL.split(', l AS')[0]} SELECT patch, date_start, arg_min(i, (abs(date_diff('day', (ym || '-01')::DATE, date_start::DATE)) * 100000 + i)) AS i
FROM (SELECT DISTINCT patch, date_start FROM patch_map) CROSS JOIN x GROUP BY patch, date_start""",
}
