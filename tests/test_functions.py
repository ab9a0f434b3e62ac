import pytest
from pyspark.sql import functions as F

from embertrace.functions import context as C
from embertrace.functions import dist
from embertrace.functions import text as T
from embertrace.operators import joins as J
from embertrace.operators import rules as R


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_outcome_and_minutes(spark):
    rows = [(s, w, m) for s in (0.0, 127.0, 128.0, 132.0, None) for w in (True, False, None) for m in (7.5, 22.5)]
    got = one(spark, rows, "s double, w boolean, m double", C.outcome(F.col("s"), F.col("w")), C.minute(F.col("m")))
    for (s, w, m), (o, x) in zip(rows, got, strict=True):
        assert o == ("unknown" if s is None or w is None else "win" if (s < 128) == w else "loss")
        assert x == {7.5: 0.12, 22.5: 0.38}[m]  # half to even


def test_bins_are_right_closed(spark):
    got = one(spark, [(y,) for y in (2015, 2016, 2018, 2019, 2021, 2022, 2026, 2027, None)], "y int", C.year_bin(F.col("y")))
    assert [g[0] for g in got] == [None, "2016-2018", "2016-2018", "2019-2021", "2019-2021", "2022-2026", "2022-2026", None, None]
    got = one(spark, [(y,) for y in (0, 1, 1800, 1801, 2700, 2701, 7200, 7201)], "y int", C.duration_bin(F.col("y")))
    assert [g[0] for g in got] == [None, "short", "short", "medium", "medium", "long", "long", None]


def test_tier_and_phase(spark):
    names = ["The International 2019", "The International 10", "The International League", "X Major Qualifier", "X Major", "DPC 2021 Tour 1", None, "The International Major"]
    got = one(spark, [(n, "professional") for n in names], "n string, t string", C.tier(F.col("n"), F.col("t")))
    assert [g[0] for g in got] == ["TI", "TI", C.OTHER, C.OTHER, "Major", "DPC Tour", C.OTHER, C.OTHER]
    got = one(spark, [("X Major", t) for t in ("excluded", "amateur", "", None, "premium")], "n string, t string", C.tier(F.col("n"), F.col("t")))
    assert [g[0] for g in got] == [C.OTHER] * 4 + ["Major"]
    got = one(spark, [(n,) for n in ("Grand Final", "Finals", "Semifinals", "Playoffs", "Group Stage", None)], "n string", C.phase(F.col("n")))
    assert [g[0] for g in got] == ["grand_final", "playoffs", C.NO_PHASE, "playoffs", "group_stage", C.NO_PHASE]


def test_slang(spark):
    texts = ["gg", "GG EZ!", "noob!!", "???", "you played really well", "", None, "well played all", "bot", "swell played"]
    got = [g[0] for g in one(spark, [(t,) for t in texts], "t string", T.translate_slang(F.col("t")))]
    assert got == ["good game", "good game easy", "bad player", "???", "you played really well", "", "", "good performance all", "bad player", "swell played"]


def test_norms_and_bigrams(spark):
    got = one(spark, [("  A  b!  C ",), ("",), (None,)], "t string", T.norm_full(F.col("t")), T.norm_strict(F.col("t")), F.size(T.tokens(F.coalesce("t", F.lit("")))))
    assert got[0] == ("a b! c", "a bc", 3) and got[1] == ("", "", 0) and got[2][0] is None
    assert one(spark, [(["a", "b", "c"],), (["a"],), ([],)], "t array<string>", T.bigrams(F.col("t"))) == [(["a b", "b c"],), ([],), ([],)]


def test_flags_and_argmax(spark):
    rows = [(0.5, 0.2), (None, 0.4), (float("nan"), None), (0.4, 0.4)]
    got = one(spark, rows, "a double, b double", C.flag(F.col("a")), C.argmax_label([("a", F.nanvl("a", F.lit(None).cast("double"))), ("b", F.col("b"))]))
    assert got == [(1, "a"), (0, "b"), (0, None), (0, "a")]


def test_language_gates(spark):
    rows = [("gg",), ("ez wp",), ("a b c d e",), ("the tower is in the way of it",), ("привет",), ("a,b",), (None,), ("",)]
    got = R.language_columns(spark.createDataFrame(rows, "t string"), "t").collect()
    assert [(r["lang"], r["lang_source"]) for r in got] == [("en", "short_circuit")] * 3 + [("en", "stopwords"), ("ru", "stopwords"), ("en", "stopwords") if False else ("und", "stopwords"), ("und", "stopwords"), ("und", "stopwords")]
    with pytest.raises(ValueError):
        R.detect_language(F.col("t"), "nothing")
    R.register_detector("first", lambda ts: ["xx" if ts[0][0] == "g" else 1 / 0])
    got = spark.createDataFrame([("gg",), ("no",), (None,)], "t string").select(R.detect_language(F.col("t"), "first")).collect()
    assert [r[0] for r in got] == ["xx", "und", "und"]


def test_rules_take_the_first_that_applies(spark):
    rows = [("ez", "win", 10.0, 100), ("ez", "loss", 10.0, 100), ("gg", "win", 95.0, 100), ("gg", "win", 85.0, 100), ("gg", "win", 5.0, 100), ("you idiot", "win", 1.0, 100), ("???", "win", 1.0, None), (None, None, None, None)]
    d = spark.createDataFrame(rows, "key string, match_outcome_for_player string, time double, duration int").select(R.chat_rules().label().alias("x")).select("x.category").collect()
    assert [r[0] for r in d] == ["ez_win", "ez_other", "gg_end", "gg_late", "gg_early", "insult", "punctuation", "punctuation"]


def test_keep_first_and_many_to_one(spark):
    right = spark.createDataFrame([(1, None, "z"), (1, 5, "b"), (1, 4, "c"), (2, 1, "d")], "k int, o int, v string")
    assert sorted(map(tuple, J.keep_first(right, ["k"], ["o"]).collect())) == [(1, 4, "c"), (2, 1, "d")]
    left = spark.createDataFrame([(1, "old"), (1, "old"), (3, "old"), (None, "old")], "k int, v string")
    j = J.many_to_one(left, right, ["k"], ["o"])
    J.assert_no_inflation(left, j)
    assert sorted((r["k"] or 0, r["v"]) for r in j.where("v IS NOT NULL").collect()) == [(1, "c"), (1, "c")]
    with pytest.raises(ValueError):
        J.assert_no_inflation(left, left.unionByName(left))
    assert J.schema_difference(left, ["k", "w"]) == (["w"], ["v"])


def test_tails():
    assert abs(dist.f_sf(3.8792266131, 2, 120) - 0.0233) < 1e-4
    assert abs(dist.chi2_sf(3.841458821, 1) - 0.05) < 1e-9 and abs(dist.chi2_sf(18.307038, 10) - 0.05) < 1e-7
    assert abs(dist.t_two_sided(2.228138852, 10) - 0.05) < 1e-9 and abs(dist.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert dist.normal_two_sided(30.0) > 0  # a survival function doesn't underflow early
