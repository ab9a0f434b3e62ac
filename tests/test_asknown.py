from datetime import datetime, timedelta

from pyspark.sql import functions as F

from embertrace.operators.asknown import as_known_join
from embertrace.operators.joins import asof_clip

D0 = datetime(2020, 1, 1)
FACTS = "k string, f timestamp_ntz, t timestamp_ntz, known timestamp_ntz, v string"


def day(n, s=0):
    return D0 + timedelta(days=n, seconds=s)


def brute(k, at, facts):
    if at is None or k is None:
        return None
    ok = [((f, kn or f, v), v) for fk, f, t, kn, v in facts if fk == k and f is not None and f <= at and (t is None or at < t) and (kn is None or kn <= at)]
    return max(ok)[1] if ok else None


def test_against_brute_force(spark):
    facts = []
    for i in range(60):
        f = day((i * 37) % 400, i)
        facts.append((("a", "b")[i % 2], f, None if i % 13 == 0 else f + timedelta(days=20 + i % 90), None if i % 3 else f + timedelta(days=(i * 7) % 40 - 10), f"v{i}"))
    facts += [facts[3], facts[3]]
    facts += [("a", None, day(9), None, "never"), ("a", day(50), day(40), None, "backwards")]
    events = [(i, ("a", "b", "c", None)[i % 4], None if i % 17 == 0 else day((i * 11) % 520 - 30, i * 997)) for i in range(400)]
    events += [(1000 + i, fact[0], fact[1]) for i, fact in enumerate(facts) if fact[1]]  # exactly at a start
    events += [(2000 + i, fact[0], fact[2]) for i, fact in enumerate(facts) if fact[2]]  # exactly at an end
    e = spark.createDataFrame(events, "id int, k string, at timestamp_ntz")
    for period in (1, 32, 5000):
        got = as_known_join(e, spark.createDataFrame(facts, FACTS), event_time="at", valid_from="f", valid_to="t", known_at="known", value="v", keys=["k"], period_days=period, salts=3)
        rows = {r["id"]: r["value"] for r in got.collect()}
        assert rows == {i: brute(k, at, facts) for i, k, at in events}


def test_edges(spark):
    facts = spark.createDataFrame([("a", day(0), None, None, "x")], FACTS)
    e = spark.createDataFrame([(1, "a", day(5), "keep")] * 2, "id int, k string, at timestamp_ntz, value string")
    got = as_known_join(e, facts, event_time="at", valid_from="f", valid_to="t", known_at="known", value="v", keys=["k"])
    assert [(r["id"], r["value"]) for r in got.collect()] == [(1, "x"), (1, "x")]  # repeats stay, the clash is replaced
    assert as_known_join(e.where("false"), facts, event_time="at", valid_from="f", valid_to="t", known_at="known", value="v", keys=["k"]).count() == 0
    none = as_known_join(e, facts.where("false"), event_time="at", valid_from="f", valid_to="t", known_at="known", value="v", keys=["k"])
    assert [r["value"] for r in none.collect()] == [None, None]


def test_asof_clips_to_the_first(spark):
    points = spark.createDataFrame([(day(10), "p1"), (day(20), "p2"), (day(20), "p2"), (None, "p9")], "s timestamp_ntz, v string")
    left = spark.createDataFrame([(1, day(3)), (2, day(10)), (3, day(19, 86399)), (4, day(20)), (5, day(9000)), (6, None)], "id int, t timestamp_ntz")
    got = {r["id"]: r["o"] for r in asof_clip(left, points, "t", "s", "v", "o").collect()}
    assert got == {1: "p1", 2: "p1", 3: "p1", 4: "p2", 5: "p2", 6: None}


def test_known_later_is_never_used(spark):
    facts = spark.createDataFrame([("a", day(0), day(100), None, "old"), ("a", day(10), day(100), day(30), "new")], FACTS)
    e = spark.createDataFrame([(n, "a", day(n)) for n in (9, 10, 29, 30, 99, 100)], "id int, k string, at timestamp_ntz")
    got = as_known_join(e, facts, event_time="at", valid_from="f", valid_to="t", known_at="known", value="v", keys=["k"])
    assert {r["id"]: r["value"] for r in got.select("id", F.col("value")).collect()} == {9: "old", 10: "old", 29: "old", 30: "new", 99: "new", 100: None}


def test_periods_of_any_length_give_the_same(spark, monkeypatch):
    import random

    from embertrace.operators import asknown

    r = random.Random(9)
    day = datetime(1969, 12, 20)
    facts = [(k, day + timedelta(seconds=r.randrange(40 * 86400), microseconds=r.choice([0, 1, 500000])), day + timedelta(days=r.randrange(1, 80)), r.choice([None, day + timedelta(hours=r.randrange(900))]), f"v{i}") for i in range(60) for k in (1, 2)]
    events = [(r.choice([1, 2, None]), day + timedelta(seconds=r.randrange(60 * 86400), microseconds=r.choice([0, 1, 999999]))) for _ in range(200)] + [(1, f[1]) for f in facts[:20]]
    f = spark.createDataFrame(facts, "k int, a timestamp_ntz, b timestamp_ntz, known timestamp_ntz, v string")
    e = spark.createDataFrame(events, "k int, at timestamp_ntz")
    want = []
    for k, at in events:
        held = [(a, known or a, v) for kk, a, b, known, v in facts if kk == k and max(a, known or a) <= at < b]
        want.append((k, at, max(held)[2] if held else None))
    order = lambda rows: sorted(map(str, rows))
    for most in (1000, 3):
        monkeypatch.setattr(asknown, "MOST_CHANGES", most)
        monkeypatch.setattr(asknown.period_length, "__defaults__", (most,))
        got = as_known_join(e, f, event_time="at", valid_from="a", valid_to="b", known_at="known", value="v", out="v", keys=["k"], period_days=4)
        assert order(map(tuple, got.select("k", "at", "v").collect())) == order(want)
