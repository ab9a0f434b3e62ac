"""Queries of the text, language and rule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions import text as T
from embertrace.operators import message_labels as M
from embertrace.operators import rules as R
from embertrace.session import table

GAME_WORDS = ("rosh", "smoke", "ward", "tower", "high ground", "creep line", "shot caller")


def clean_messages(spark: SparkSession, root: str) -> DataFrame:
    """Messages without wheel phrases and blanks: stripped text and its lower-case copy."""
    p = table(spark, root, "processed").select("match_id", "time", "player_slot", "type", "key")
    p = p.where(F.lower(F.coalesce("type", F.lit(""))) != "chatwheel").withColumn("key", T.strip(F.coalesce("key", F.lit(""))))
    return p.where("key <> ''").select("match_id", "time", "player_slot", "key", F.lower("key").alias("key_lower"))


def clean_counts(spark: SparkSession, root: str) -> DataFrame:
    """Stage counters of cleaning in one pass."""
    p = table(spark, root, "processed").select("type", "key")
    wheel = F.lower(F.coalesce("type", F.lit(""))) == "chatwheel"
    empty = T.strip(F.coalesce("key", F.lit(""))) == ""
    return p.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(wheel).alias("n_wheel"), F.count_if(~wheel & empty).alias("n_empty"), F.count_if(~wheel & ~empty).alias("n_out"))


def nfkc_normalize(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key")
    return e.select("idx", T.nfkc("key").alias("nfkc"))


def text_norms(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold").select("gold_id", F.coalesce("key", F.lit("")).alias("key"))
    return g.select("gold_id", T.norm_full(F.col("key")).alias("norm_full"), T.norm_strict(F.col("key")).alias("norm_strict"),
                    F.size(T.tokens(F.col("key"))).alias("n_tokens"), F.size(T.alpha_tokens(F.col("key"))).alias("n_alpha"))


def lexicon_flags(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").select("idx", F.coalesce("key", F.lit("")).alias("key"))
    toks = T.alpha_tokens(F.col("key"))
    return e.select("idx", F.col("key").rlike(T.PROFANITY).alias("profane"),
                    F.arrays_overlap(toks, F.array(*[F.lit(b) for b in T.BLOCKERS])).alias("blocked"),
                    T.first_hit(F.lower("key"), ["f+u+c+k+", "idi+o+t", "go+b+l+o+k", "tr+a+sh", "shut up", "go back to"]).alias("first_hit"))


def translate_slang(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "gold").select("gold_id", "key")
    return p.select("gold_id", T.translate_slang(F.col("key")).alias("plain"))


def slang_coverage(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("key")
    n, known, hit = T.slang_hits(F.col("key"))
    return p.agg(F.count(F.lit(1)).alias("n_messages"), F.round(F.avg(hit.cast("double")), 6).alias("message_hit_rate"),
                 F.round(F.sum(known) / F.sum(n), 6).alias("token_hit_rate"), F.lit(len(T.SLANG)).alias("n_slang"), F.lit(len(T.PHRASES)).alias("n_phrases"))


def game_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Game words and two-word terms in each text."""
    g = table(spark, root, "gold").select("gold_id", F.coalesce("text", F.lit("")).alias("text"))
    toks = T.alpha_tokens(F.col("text"))
    hits = F.array_sort(F.array_intersect(F.array_union(toks, T.bigrams(toks)), F.array(*[F.lit(w) for w in GAME_WORDS])))
    return g.select("gold_id", F.array_join(hits, ",").alias("hits"), (F.size(hits) > 0).alias("has_game_word"))


def export_text(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", "text")
    return d.select("doc_id", F.substring(F.regexp_replace("text", "\n", " "), 1, 200).alias("shown"))


def lang_short_circuit(spark: SparkSession, root: str) -> DataFrame:
    e = R.language_columns(table(spark, root, "enriched_gold_labeled").select("idx", "key"), "key")
    return e.select("idx", "lang", "lang_source")


def lang_split_counts(spark: SparkSession, root: str) -> DataFrame:
    """Messages and share by language and source of the label (English and the other output)."""
    e = R.language_columns(table(spark, root, "processed").select("key"), "key")
    return e.groupBy((F.col("lang") == "en").alias("english"), "lang_source").agg(F.count(F.lit(1)).alias("n"))


def lang_markers(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enriched_gold_labeled").select("idx", "key")
    return e.select("idx", F.array_join(R.marker_languages(F.col("key")), ",").alias("tags"), R.is_indonesian(F.col("key")).alias("indonesian"))


def rule_labels(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "gold").select("gold_id", "key", "match_outcome_for_player", "time", "duration")
    return p.withColumn("x", R.chat_rules().label()).where("x IS NOT NULL").select("gold_id", "x.category", "x.sentiment", "x.toxic", "x.insult", "x.obscene", "x.note")


def rule_label_counts(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "processed").select("key", "match_outcome_for_player", "time", "duration")
    return p.select(F.coalesce(R.chat_rules().label()["category"], F.lit("none")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def message_labels(spark: SparkSession, root: str) -> DataFrame:
    """Messages of all kinds by the 21 categories: rows, and sums of their flags."""
    p = table(spark, root, "processed").select("key", "match_outcome_for_player", "time", "duration")
    x = p.select(M.message_label(F.col("key"), F.col("time"), F.col("duration"), F.col("match_outcome_for_player")).alias("x")).select("x.*")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*R.TOX, "is_jargon", "is_ambiguous")]
    return x.groupBy(F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("sentiment", F.lit("none")).alias("sentiment_label")).agg(F.count(F.lit(1)).alias("n"), *sums)


def residual_labels(spark: SparkSession, root: str) -> DataFrame:
    """Messages that the 21 categories leave, by the residual tiers."""
    p = table(spark, root, "processed").select("key", "match_outcome_for_player", "time", "duration")
    p = p.where(M.message_label(F.col("key"), F.col("time"), F.col("duration"), F.col("match_outcome_for_player")).isNull())
    return p.select(M.residual_label(F.col("key")).alias("x")).groupBy("x.category", "x.sentiment", "x.confidence").agg(F.count(F.lit(1)).alias("n"))


def lexicon_scores(spark: SparkSession, root: str) -> DataFrame:
    return R.score_in_batches(table(spark, root, "gold"), ["gold_id"], "text", R.lexicon_scorer, ["toxic"])


QUERIES = {f.__name__: f for f in (
    clean_messages, clean_counts, nfkc_normalize, text_norms, lexicon_flags, translate_slang, slang_coverage, game_tokens, export_text,
    lang_short_circuit, lang_split_counts, lang_markers, rule_labels, rule_label_counts, message_labels, residual_labels, lexicon_scores)}

_S = T.SPACE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^{_S}+|{_S}+$')}, '', 'g')"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {_q(_S + '+')}), lambda t: t <> '')"


def _alpha(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z]+')"


def _strict(c: str) -> str:
    return f"regexp_replace(lower({c}), {_q(r'''[!.?,~\s"']+''')}, '', 'g')"


def _map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in d.items()) + "}"


def _slang_sql() -> str:
    order = sorted(T.PHRASES, key=lambda p: (-len(p), p))
    low = _strip("lower(coalesce(key, ''))")
    marked = low
    for i, p in enumerate(order):
        marked = f"regexp_replace({marked}, {_q(rf'\b{p}\b')}, chr(1) || '{i}' || chr(1), 'g')"
    core = r"^[^\w\x{01}\x{80}-\x{10FFFF}]+|[^\w\x{01}\x{80}-\x{10FFFF}]+$"
    marks = "map_concat(" + _map(T.SLANG) + ", map_from_entries([" + ", ".join(f"(chr(1) || '{i}' || chr(1), {_q(T.PHRASES[p])})" for i, p in enumerate(order)) + "]))"
    return f"""
WITH m AS (SELECT gold_id, {low} AS low, {marked} AS marked, {marks} AS d FROM gold),
t AS (SELECT gold_id, low, d, unnest({_tokens('marked')}) AS tok, generate_subscripts({_tokens('marked')}, 1) AS k FROM m),
c AS (SELECT *, regexp_replace(tok, {_q(core)}, '', 'g') AS core FROM t),
o AS (SELECT gold_id, string_agg(CASE WHEN core <> '' THEN coalesce(d[core], tok) END, ' ' ORDER BY k) AS plain FROM c GROUP BY gold_id)
SELECT m.gold_id, coalesce(nullif(o.plain, ''), m.low) AS plain FROM m LEFT JOIN o ON o.gold_id = m.gold_id"""


def _lang_case(c: str) -> str:
    toks = _tokens(f"lower(coalesce({c}, ''))")
    counts = [f"len(list_filter({toks}, lambda t: list_contains({_list(w.split())}, t)))" for w in R.STOP_WORDS.values()]
    best = "greatest(" + ", ".join(counts) + ")"
    pick = " ".join(f"WHEN {n} = {best} THEN '{lang}'" for n, lang in zip(counts, R.STOP_WORDS, strict=True))
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '[\\x{{0400}}-\\x{{04FF}}]') THEN 'ru' WHEN {best} = 0 THEN 'und' {pick} END"


def _short(c: str) -> str:
    return f"(len({_tokens(c)}) <= 5 AND regexp_matches(coalesce({c}, ''), {_q(R.SHORT_ENGLISH)}))"


def _hits(c: str, ws) -> str:
    return f"len(list_filter({_tokens(f'''lower(coalesce({c}, ''))''')}, lambda t: list_contains({_list(ws)}, t)))"


def _rules_sql(source: str, key: str = "key") -> str:
    s, toks = _strict(f"coalesce({key}, '')"), _alpha(f"coalesce({key}, '')")
    ratio = "(time / nullif(duration, 0))"
    m = lambda p: f"regexp_matches(s, {_q(p)})"
    cases = [
        ("insult", f"list_has_any(toks, {_list(T.BLOCKERS)}) AND len(toks) <= 3"),
        ("ez_win", m(r"^e+z+(gg|mid|game|wp)*$") + " AND match_outcome_for_player = 'win'"), ("ez_other", m(r"^e+z+(gg|mid|game|wp)*$")),
        ("forfeit", m(r"^(ff|gg?ff|forfeit)$")), ("obscene", f"regexp_matches(coalesce({key}, ''), {_q(T.PROFANITY)})"),
        ("coordination", m(r"^(go|push|mid|rosh|b|back|smoke|goend|end|ss|re|wait|ready)$")), ("apology", m(r"^(sry|sorry|mb|mybad)$")),
        ("acknowledge", m(r"^(ok|okay|k|yes|no|np|ty|thx|thanks|sure)$")), ("technical", m(r"^(pause|unpause|lag|lags|dc|brb|afk|sec)$")),
        ("laughter", m(r"^(x+d+|l+o+l+|lmao|(ha)+h?)$")), ("sport", m(r"^(wp|ggwp|nice|gj|wellplayed|glhf|wow)$")),
        ("gg_end", m(r"^g+g+(wp)?$") + f" AND {ratio} >= 0.95"), ("gg_late", m(r"^g+g+(wp)?$") + f" AND {ratio} >= 0.85"), ("gg_early", m(r"^g+g+(wp)?$")),
        ("punctuation", m(r"^[^a-z0-9]*$")),
    ]
    case = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in cases) + " END"
    return f"SELECT *, {case} AS category FROM (SELECT *, {s} AS s, {toks} AS toks FROM {source})"


_NEG = "('insult', 'ez_win', 'forfeit', 'obscene', 'gg_early')"
_POS = "('laughter', 'sport', 'gg_end')"
_NOTES = "CASE category WHEN 'ez_win' THEN 'taunt by the winner' WHEN 'ez_other' THEN 'ambiguous' WHEN 'gg_end' THEN 'closing' WHEN 'gg_late' THEN 'late' WHEN 'gg_early' THEN 'giving up early' ELSE '' END"
_GOOD = ("nice", "wp", "good", "best", "thanks", "love", "great")

ORACLES = {
    "message_labels": f"""SELECT coalesce(category, 'none') AS category, coalesce(sentiment_label, 'none') AS sentiment_label, count(*) AS n, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in (*R.TOX, "is_jargon", "is_ambiguous"))}
FROM {M.message_label_sql("(SELECT key, match_outcome_for_player, time, duration FROM processed)")} GROUP BY ALL""",
    "clean_messages": f"""SELECT match_id, time, player_slot, k AS key, lower(k) AS key_lower FROM (
  SELECT match_id, time, player_slot, {_strip("coalesce(key, '')")} AS k FROM processed WHERE lower(coalesce(type, '')) <> 'chatwheel') WHERE k <> ''""",
    "clean_counts": f"""SELECT count(*) AS n_in, count(*) FILTER (WHERE w) AS n_wheel, count(*) FILTER (WHERE NOT w AND e) AS n_empty, count(*) FILTER (WHERE NOT w AND NOT e) AS n_out
FROM (SELECT lower(coalesce(type, '')) = 'chatwheel' AS w, {_strip("coalesce(key, '')")} = '' AS e FROM processed)""",
    "text_norms": f"""SELECT gold_id, regexp_replace({_strip('lower(k)')}, {_q(_S + '+')}, ' ', 'g') AS norm_full, {_strict('k')} AS norm_strict,
  len({_tokens('k')})::INT AS n_tokens, len({_alpha('k')})::INT AS n_alpha FROM (SELECT gold_id, coalesce(key, '') AS k FROM gold)""",
    "lexicon_flags": f"""SELECT idx, regexp_matches(k, {_q(T.PROFANITY)}) AS profane, list_has_any({_alpha('k')}, {_list(T.BLOCKERS)}) AS blocked,
  coalesce({', '.join(f"nullif(regexp_extract(lower(k), {_q(p)}), '')" for p in ["f+u+c+k+", "idi+o+t", "go+b+l+o+k", "tr+a+sh", "shut up", "go back to"])}) AS first_hit
FROM (SELECT idx, coalesce(key, '') AS k FROM enriched_gold_labeled)""",
    "translate_slang": _slang_sql(),
    "slang_coverage": f"""WITH t AS (SELECT lower(coalesce(key, '')) AS low FROM processed),
u AS (SELECT low, list_transform({_tokens('low')}, lambda t: regexp_replace(t, '^[^\\w\\x{{80}}-\\x{{10FFFF}}]+|[^\\w\\x{{80}}-\\x{{10FFFF}}]+$', '', 'g')) AS toks FROM t),
c AS (SELECT low, len(toks) AS n, len(list_filter(toks, lambda t: list_contains({_list(sorted(T.SLANG))}, t))) AS known FROM u)
SELECT count(*) AS n_messages, round(avg(CASE WHEN known > 0 OR {' OR '.join(f"contains(low, {_q(p)})" for p in sorted(T.PHRASES))} THEN 1.0 ELSE 0.0 END), 6) AS message_hit_rate,
  round(sum(known) / sum(n), 6) AS token_hit_rate, {len(T.SLANG)} AS n_slang, {len(T.PHRASES)} AS n_phrases FROM c""",
    "game_tokens": f"""WITH t AS (SELECT gold_id, {_alpha("coalesce(text, '')")} AS toks FROM gold),
h AS (SELECT gold_id, list_sort(list_distinct(list_filter(list_concat(toks, list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])), lambda w: list_contains({_list(GAME_WORDS)}, w)))) AS hits FROM t)
SELECT gold_id, array_to_string(hits, ',') AS hits, len(hits) > 0 AS has_game_word FROM h""",
    "export_text": "SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 200) AS shown FROM documents",
    "lang_short_circuit": f"SELECT idx, CASE WHEN coalesce({_short('key')}, false) THEN 'en' ELSE {_lang_case('key')} END AS lang, CASE WHEN coalesce({_short('key')}, false) THEN 'short_circuit' ELSE 'stopwords' END AS lang_source FROM enriched_gold_labeled",
    "lang_split_counts": f"""SELECT lang = 'en' AS english, lang_source, count(*) AS n FROM (
  SELECT CASE WHEN coalesce({_short('key')}, false) THEN 'en' ELSE {_lang_case('key')} END AS lang, CASE WHEN coalesce({_short('key')}, false) THEN 'short_circuit' ELSE 'stopwords' END AS lang_source FROM processed) GROUP BY ALL""",
    "lang_markers": f"""WITH t AS (SELECT idx, key, {_alpha("coalesce(key, '')")} AS toks FROM enriched_gold_labeled)
SELECT idx, array_to_string(list_filter([
  CASE WHEN {_hits('key', ('blyat', 'suka', 'cyka', 'davai', 'chto', 'esli'))} > 0 OR regexp_matches(coalesce(key, ''), '[\\x{{0400}}-\\x{{04FF}}]') THEN 'ru' END,
  CASE WHEN {_hits('key', ('putangina', 'bobo', 'gago', 'tanga'))} > 0 THEN 'fil' END, CASE WHEN {_hits('key', ('vcl', 'dkm', 'ngu'))} > 0 THEN 'vi' END,
  CASE WHEN {_hits('key', ('que', 'el', 'los', 'por', 'una', 'con'))} >= 2 THEN 'es' END], lambda x: x IS NOT NULL), ',') AS tags,
  list_has_any(toks, {_list(R.STRONG_ID)}) OR (len(toks) >= 2 AND len(list_filter(toks, lambda t: list_contains({_list(R.STRONG_ID + R.WEAK_ID)}, t))) / len(toks) >= 0.3) AS indonesian FROM t""",
    "rule_labels": f"""SELECT gold_id, category, CASE WHEN category IN {_NEG} THEN 'negative' WHEN category IN {_POS} THEN 'positive' ELSE 'neutral' END AS sentiment,
  (category IN ('insult', 'ez_win', 'obscene'))::INT AS toxic, (category IN ('insult', 'ez_win'))::INT AS insult, (category = 'obscene')::INT AS obscene, {_NOTES} AS note
FROM ({_rules_sql('gold')}) WHERE category IS NOT NULL""",
    "rule_label_counts": f"SELECT coalesce(category, 'none') AS category, count(*) AS n FROM ({_rules_sql('processed')}) GROUP BY 1",
    "residual_labels": f"""SELECT category, sentiment, confidence, count(*) AS n
FROM {M.residual_label_sql(f"(SELECT key FROM {M.message_label_sql('(SELECT key, match_outcome_for_player, time, duration FROM processed)')} WHERE category IS NULL)")} GROUP BY ALL""",
}
