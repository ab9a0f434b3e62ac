import duckdb
import pytest
from pyspark.sql import functions as F

from embertrace.operators import message_labels as M

#: text, outcome, time over duration of 1000, category, sentiment, flags that are 1
CASES = [
    ("noob", "win", 10, "insult", "negative", {"toxic", "insult"}), ("what a trash, team", "win", 10, "insult", "negative", {"toxic", "insult"}),
    ("you are all really such noobs", "win", 10, None, None, set()), ("ez", "win", 10, "ez", "negative", {"toxic", "insult"}), ("EZ!!", "loss", 10, "ez", "negative", {"is_ambiguous"}),
    ("ff", "loss", 10, "ff", "negative", set()), ("ff", "win", 10, "ff", "negative", {"toxic", "is_ambiguous"}), ("ff", None, 10, "ff", "negative", {"is_ambiguous"}),
    ("wtf", "win", 10, "obscene", "negative", {"obscene", "is_ambiguous"}), ("fuck you all", "win", 10, "obscene", "negative", {"toxic", "obscene", "insult"}),
    ("g", "win", 10, "init", "neutral", {"is_jargon", "is_ambiguous"}), ("go go", "win", 10, "init", "neutral", {"is_jargon"}), ("b", "win", 10, "coord", "neutral", {"is_jargon", "is_ambiguous"}),
    ("rosh now", "win", 10, "coord", "neutral", {"is_jargon"}), ("my bad", "win", 10, "apology", "positive", set()), ("ok", "win", 10, "ack", "neutral", set()), ("k", "win", 10, "ack", "neutral", {"is_ambiguous"}),
    ("1 min", "win", 10, "timer", "neutral", set()), ("lag", "win", 10, "tech", "neutral", set()), ("xDDD", "win", 10, "xd", "positive", {"is_ambiguous"}), ("glgl", "win", 10, "sport_rep", "positive", set()),
    ("well played", "win", 10, "sport", "positive", set()), ("gee gee", "win", 10, "gg_phonetic", "positive", {"is_jargon"}), ("gg team", "win", 960, "gg_compound", "positive", {"is_jargon"}),
    ("gg team", "win", -5, "gg_compound", "neutral", {"is_jargon", "is_ambiguous"}), ("gg team", "win", 100, "gg_compound", "positive", {"is_jargon", "is_ambiguous"}), ("gg team", "win", None, "gg_compound", "positive", {"is_jargon", "is_ambiguous"}),
    ("that was a good game my friends of old", "win", 10, "sport_compound", "positive", set()), ("sorry about this one", "win", 10, "apology_compound", "positive", {"is_ambiguous"}),
    ("so much lag here", "win", 10, "tech_compound", "neutral", set()), ("sad", "win", 10, "react", "negative", {"is_ambiguous"}), ("lost", "win", 10, "react", "neutral", {"is_ambiguous"}),
    ("???", "win", 10, "punct", "neutral", {"is_ambiguous"}), ("...", "win", 10, None, None, set()), ("", "win", 10, None, None, set()), (None, "win", 10, None, None, set()), ("   ", None, None, None, None, set()),
    ("main kayak goblokkk", "win", 10, "toxic_foreign", "negative", {"toxic", "obscene", "insult"}), ("son of a bitch", "win", 10, "toxic_foreign", "negative", {"toxic", "obscene", "insult"}),
    ("farm the river, please", "win", 10, None, None, set()), ("word " * 5000, "win", 10, None, None, set()),
]
FLAGS = (*M.TOX, "is_jargon", "is_ambiguous")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, o, None if x is None else float(x), 1000) for i, (t, o, x, *_) in enumerate(CASES)] + [(len(CASES), "gg team", "win", 5.0, 0)]
    return spark.createDataFrame(rows, "i int, key string, match_outcome_for_player string, time double, duration long")


def labelled(table):
    x = M.message_label(F.col("key"), F.col("time"), F.col("duration"), F.col("match_outcome_for_player"))
    return {r["i"]: r["x"] for r in table.select("i", x.alias("x")).collect()}


def test_every_category(table):
    got = labelled(table)
    for i, (text, _, _, category, sentiment, flags) in enumerate(CASES):
        x = got[i]
        assert (x and (x["category"], x["sentiment"], {f for f in FLAGS if x[f]})) == (category and (category, sentiment, flags)), text
    assert len({c[3] for c in CASES} - {None}) == 21 and got[len(CASES)]["is_ambiguous"] == 1


def test_the_sql_says_the_same(table):
    t = table.toPandas()  # noqa: F841
    got = duckdb.sql(f"SELECT i, category, sentiment_label, {', '.join(FLAGS)} FROM {M.message_label_sql('t')} ORDER BY i").fetchall()
    ours = labelled(table)
    assert [(i, *((x["category"], x["sentiment"], *[x[f] for f in FLAGS]) if x else (None,) * 10)) for i, x in sorted(ours.items())] == [(*r,) for r in got]


def test_tables_can_be_replaced(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"insult": ["pudding"]}')
    w = M.load_tables(str(tmp_path / "t.json"))
    d = spark.createDataFrame([("pudding",), ("noob",)], "key string")
    n = F.lit(None).cast("double")
    assert [r[0] for r in d.select(M.message_label(F.col("key"), n, n, F.lit("win"), w)["category"]).collect()] == ["insult", None]


RESIDUAL = [
    (":D", "emoticon", "positive", "high"), (":(", "symbols", "neutral", "high"), ("#$%", "symbols", "neutral", "high"), ("z", "letter", "neutral", "high"), ("hello guys", "greeting", "positive", "high"),
    ("hola", "foreign_ack", "neutral", "high"), ("12 34", "numbers", "neutral", "high"), ("smoke rosh", "game_only", "neutral", "high"), ("gwrr", "unknown", "neutral", "ASK"),
    ("ka le", "unknown", "neutral", "ASK"), ("they all play like clowns in every single lane", "abuse", "negative", "medium"), ("so very sorry about all of this", "apology", "positive", "medium"),
    ("that was a nice idea", "sport", "positive", "medium"), ("my pause was too long again", "tech", "neutral", "medium"), ("take the tower with us", "game", "neutral", "medium"),
    ("we were walking over there for hours", "long_talk", "neutral", "low"), ("who is it", "talk", "neutral", "low"), ("", None, None, None), (None, None, None, None), ("  ", None, None, None),
]


def test_residual_tiers_and_their_sql(spark):
    t = spark.createDataFrame([(x[0],) for x in RESIDUAL], "key string")
    got = [(r["key"], *(r["x"] or (None,) * 3)) for r in t.select("key", M.residual_label(F.col("key")).alias("x")).collect()]
    assert got == RESIDUAL
    p = t.toPandas()  # noqa: F841
    order = lambda rows: sorted(map(str, rows))
    assert order(duckdb.sql(f"SELECT * FROM {M.residual_label_sql('p')}").fetchall()) == order(RESIDUAL)
