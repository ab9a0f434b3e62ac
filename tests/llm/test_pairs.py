import random
from pathlib import Path

import pytest

from embertrace.llm import lookalike as L
from embertrace.llm import overlap as O
from embertrace.llm import quota as U
from embertrace.llm import splits as S

LONG = "word after word " * 4000


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_edit_distance_against_the_textbook():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(2))
        assert O.edit_distance(a, b) == levenshtein(a, b)


def test_chain_cost_never_understates():
    r = random.Random(2)
    for _ in range(100):
        a = "".join(r.choice("abcdefgh") for _ in range(r.randint(60, 150)))
        b = list(a)
        for _ in range(r.randint(0, 8)):
            b[r.randrange(len(b))] = r.choice("abcdefghxyz")
        b = "".join(b)
        share, cover = O.chain_and_align(a, b)
        assert share >= levenshtein(a, b) / max(len(a), len(b)) - 1e-9 and 0 <= cover <= 1


WORDS = "river tower bottle crown shield forest lantern bridge hammer throne quiet broken second northern empty wooden carried dropped guarded stole ignored".split()


def messages(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = " ".join(r.choice(WORDS) for _ in range(r.randint(2, 22)))
        rows.append((len(rows), base, "train"))
        if i % 3 == 0:
            t = base.split()
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(t))
                t[k] = (t[k] + "!", t[k].upper(), t[k][:-1] + t[k][-1] * 3, "," + t[k])[r.randrange(4)]
            rows.append((len(rows), "  ".join(t), ("test", "validation")[i % 2]))
    return rows


def test_overlaps_against_all_pairs(spark):
    rows = messages(250, 3)
    rows += [(9000, None, "test"), (9001, "", "train"), (9002, "   ", "test"), (9003, "!!!", "train"), (9004, "! !!", "test"), (9005, LONG, "train"), (9006, LONG + "end", "test"), (9007, LONG, "train"), (9008, "gg", None), (9009, "gg", "train"), (9010, "GG!", "test")]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "id long, t string, s string, letters string")
    got = {(r["train_id"], r["eval_id"]) for r in O.cross_split_overlaps(df, "id", "t", "s").collect()}

    def letters(t):
        k = "".join(c for c in t.lower() if c.isalnum())
        return k or "".join(t.split())

    reduced = {i: letters(t) for i, t, s in rows if t and t.strip() and len(t) < 5000}
    want = set()
    for i, t, s in rows:
        for j, u, v in rows:
            if s == "train" and v in ("test", "validation") and i in reduced and j in reduced:
                a, b = reduced[i], reduced[j]
                if a == b or (abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and levenshtein(a, b) <= 0.2 * max(len(a), len(b))):
                    want.add((i, j))
    assert got >= want and got - want == {(9005, 9006), (9007, 9006)}
    assert (9003, 9004) in got and (9009, 9010) in got and not any(9008 in p for p in got)


def test_tiny_texts_against_all_pairs(spark):
    r = random.Random(11)
    texts = ["abcdefgh", "abcxefgh", "abcd", "abxd", "abcde", "abxde", "abcdefghijklmno", "abxdefgyijklzno"]
    for _ in range(60):
        t = [r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(4, 15))]
        texts.append("".join(t))
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["z"], [t[k], "z"]])
        texts.append("".join(t[:15]))
    rows = [(i, t, ("train", "test")[i % 2]) for i, t in enumerate(texts)]
    got = {(x["train_id"], x["eval_id"]) for x in O.cross_split_overlaps(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}
    assert got == {(i, j) for i, t, s in rows for j, u, v in rows if (s, v) == ("train", "test") and t and u and levenshtein(t, u) <= 0.2 * max(len(t), len(u))} and len(got) > 30


def changed(r, t, places, most):
    """t with ``most`` letters or fewer changed, in so many places."""
    cuts = sorted(r.sample(range(1, len(t)), places), reverse=True)
    for k, c in enumerate(cuts):
        n = max(1, most // places)
        room = c - (cuts[k + 1] if k + 1 < places else 0)
        new = "".join(r.choice("qwzxvj") for _ in range(n))
        t = t[:c] + new + t[c + min(n, len(t) - c, room) * r.randint(0, 1) :]
    return t


def test_every_pair_with_few_changed_places_is_found_at_any_length(spark):
    r = random.Random(21)
    rows, want = [], set()
    for n in [*range(12, 60), 64, 66, 80, 99, 104, 106, 107, 130, 167, 170, 260, 420, 900, 2500]:
        for places in (1, 2, 3):
            t = "".join(r.choice("etaoinshrdlu") for _ in range(n))
            u = changed(r, t, min(places, n // 5), max(1, int(n * 0.2)))
            rows += [(len(rows), t, "train"), (len(rows) + 1, u, "test")]
            if levenshtein(t, u) <= 0.2 * max(len(t), len(u)):
                want.add((len(rows) - 2, len(rows) - 1))
    got = {(x["train_id"], x["eval_id"]) for x in O.cross_split_overlaps(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}
    assert got >= want and len(want) > 120


def test_edits_scattered_over_the_whole_text_are_found(spark):
    r = random.Random(23)
    rows, want = [], set()
    for n in (10, 12, 18, 30, 50, 80, 120, 200, 333, 500):
        for kind in range(8):
            t = [r.choice("etaoinshrdlucmfw") for _ in range(n)]
            most = int(0.2 * n)
            at = range(0, 5 * most, 5) if kind == 0 else r.sample(range(n), most)  # every fifth letter leaves runs of four
            u = list(t)
            for k in sorted(at, reverse=True):
                how = 0 if kind < 4 else r.randrange(3)  # replaced, left out or put in
                u[k : k + 1] = [["z"], [], [u[k], "z"]][how]
            rows += [(len(rows), "".join(t), ("train", "test")[kind % 2]), (len(rows) + 1, "".join(u), ("test", "train")[kind % 2])]
            if levenshtein(t, u) <= 0.2 * max(len(t), len(u)):
                want.add((len(rows) - 2 + kind % 2, len(rows) - 1 - kind % 2))
    got = {(x["train_id"], x["eval_id"]) for x in O.cross_split_overlaps(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}
    assert got >= want and len(want) > 60


def test_counted_runs_never_lose_a_pair_of_any_length():
    r = random.Random(24)
    for n in range(8, 70):
        t = "".join(r.choice("abcd") for _ in range(n))
        us = []
        for _ in range(20):
            u = list(t)
            for _ in range(r.randint(1, max(1, n // 4))):
                k = r.randrange(len(u))
                u[k : k + 1] = r.choice([[], ["x"], [u[k], "x"]])
            us.append("".join(u))
        us = [u for u in us if len(u) >= O.LEAST]
        found = {k for _, js in O.BlockIndex(us).candidates([t]) for k in js.tolist()}
        near = {k for k, u in enumerate(us) if max(len(t), len(u)) >= O.TINY_BELOW and levenshtein(t, u) <= 0.2 * max(len(t), len(u))}
        assert found >= near


def test_hot_phrases_hide_no_pair(spark):
    r = random.Random(22)
    opening = "still laughing at how my captain "
    rows = []
    for i in range(1500):
        t = opening + " ".join(r.choice(WORDS) for _ in range(6))
        rows += [(2 * i, t, "train"), (2 * i + 1, t.replace("captain", "capitan") + "!", "test")]
    got = {(x["train_id"], x["eval_id"]) for x in O.cross_split_overlaps(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}
    assert got >= {(2 * i, 2 * i + 1) for i in range(1500)}


def test_overlaps_take_disk_in_proportion_to_the_texts(spark, tmp_path):
    r = random.Random(25)
    rows = [(i, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(22)), ("train", "train", "test")[i % 3]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    jvm = spark.sparkContext._jvm
    folders = [d.getPath() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    used = lambda: sum(f.stat().st_size for d in (*folders, tmp_path) for f in Path(d).rglob("*") if f.is_file())
    before, at = used(), spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        found = O.cross_split_overlaps(df, "id", "t", "s")  # held, so that its shuffle files are
        found.collect()
        assert used() - before < 6 * sum(len(t) for _, t, _ in rows)
    finally:
        if at.isDefined():
            spark.sparkContext.setCheckpointDir(at.get())


def test_copies_take_few_bytes_of_disk_a_row(spark, tmp_path):
    r = random.Random(26)
    texts = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 9))) for _ in range(8)) for _ in range(4000)]
    rows = [(i, texts[i % 4000], ("train", "train", "test")[i % 3]) for i in range(80_000)]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    jvm = spark.sparkContext._jvm
    folders = [d.getPath() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    used = lambda: sum(f.stat().st_size for d in (*folders, tmp_path) for f in Path(d).rglob("*") if f.is_file())
    before, at = used(), spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        found = O.cross_split_overlaps(df, "id", "t", "s")  # held, so that its shuffle files are
        n = found.count()
        taken = used() - before
        assert n >= sum(a * (20 - a) for a in (sum((i + 4000 * k) % 3 < 2 for k in range(20)) for i in range(4000)))
        assert taken < 40 * len(rows), taken / len(rows)
    finally:
        if at.isDefined():
            spark.sparkContext.setCheckpointDir(at.get())


def test_records_name_their_class_links_and_coverage(spark):
    rows = [(1, "the very same message", "train"), (2, "The very same message!", "train"), (3, "the very same message", "test"), (4, "the very same massage", "test"), (5, "nothing like it at all", "test"), (6, None, "test")]
    got = {x["id"]: (x["class"], x["n_links"], x["coverage"]) for x in O.overlap_records(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == (1, 2, 1.0) and got[3] == (1, 1, 1.0) and got[5] == (5, 0, None)
    assert got[4][:2] == (4, 1) and 0.5 < got[4][2] < 1


def test_overlaps_of_empty_tables_and_one_side(spark):
    df = spark.createDataFrame([(1, "a text", "train"), (2, "a text", "train")], "id long, t string, s string")
    assert O.cross_split_overlaps(df, "id", "t", "s").count() == 0
    assert O.cross_split_overlaps(df.where("false"), "id", "t", "s").count() == 0


def test_one_class_may_hold_a_third_of_all_rows(spark):
    rows = [(i, "the very same message again", "train") for i in range(60)] + [(100 + i, "The very same message, again", "test") for i in range(40)] + [(200 + i, f"something else number {i * 7919}", "test") for i in range(100)]
    got = O.cross_split_overlaps(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s")
    assert got.count() == 60 * 40


@pytest.fixture(scope="module")
def looks(spark):
    return L.build_table(spark)


SAME = [
    ["paypal", "pаypаl", "ｐａｙｐａｌ", "pay​pal", " paypal ", "paypal　", "pa­ypal"],
    ["café", "café", "сafé", "саfé"],
    ["no way", "no way", "no way", "nо　way"],
    ["привет", "пpивeт", "прив‍ет"], ["fine", "ﬁne"], ["TOP", "ТОР", "ΤΟΡ"], ["я думаю что он", "я дyмаю чтo oн"],
]


def test_same_look_same_form_and_different_look_different_form(looks):
    forms = [{L.consistent_form(t, looks)[0] for t in group} for group in SAME]
    assert all(len(f) == 1 for f in forms) and len(set().union(*forms)) == len(SAME)
    for a, b in (("cafe", "café"), ("Gg", "gg"), ("a  b", "a b"), ("rn", "m"), ("l", "I"), ("0", "O"), ("1", "l"), ("и", "u"), ("x2", "x²")):
        assert L.consistent_form(a, looks)[0] != L.consistent_form(b, looks)[0]
    assert L.consistent_form("привeт", looks) == ("привет", ["mixed_script"]) and L.consistent_form("оk a see", looks)[0] == "ok a see"
    assert L.consistent_form(None, looks) == (None, []) and L.consistent_form("​ ﻿", looks)[0] == ""
    assert L.consistent_form("do you see мой дом", looks)[0] == "do you see мой дом"


def test_forms_are_stable(looks):
    r = random.Random(5)
    alphabet = "abcdeopxyzABEHKMOPTX авекмнорстух ΑΒΕΗοпν​　é́"
    for _ in range(500):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        f = L.consistent_form(t, looks)[0]
        assert L.consistent_form(f, looks)[0] == f


def test_look_alike_pairs(spark, looks):
    rows = [(i, t) for i, t in enumerate(t for g in SAME for t in g)] + [(100, None), (101, ""), (102, "​"), (103, " "), (104, "paypal"), (105, LONG), (106, LONG.replace("o", "о"))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "idx long, key string, form string")
    got = {tuple(r) for r in L.look_alike_pairs(df, "idx", "key", hot_rows=3, salts=4).collect()}
    form = {i: L.consistent_form(t, looks)[0] for i, t in rows if t}
    text = dict(rows)
    want = {(i, j) for i in form for j in form if i < j and form[i] and form[i] == form[j] and text[i] != text[j]}
    assert got == want and (105, 106) in got
    assert L.look_alike_pairs(df.where("false"), "idx", "key").count() == 0
    assert set(L.with_consistent_form(df, "key").columns) == {"idx", "key", "form", "kinds"}


def test_components_against_union_find(spark):
    r = random.Random(7)
    rows = [(r.randrange(400), r.choice([None, 0, *range(1, 260)])) for _ in range(600)] + [(1000 + i, 9999) for i in range(120)] + [(2000 + i, 5000 + i // 2) for i in range(80)] + [(2000 + i, 6000 + (i + 1) // 2) for i in range(80)] + [(None, 3), (5, 7), (5, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for m, a in rows:
        if m is not None:
            find(("m", m))
            if a:
                parent[find(("m", m))] = find(("a", a))
    want = {}
    for m, _ in rows:
        if m is not None:
            want.setdefault(find(("m", m)), set()).add(m)
    df = spark.createDataFrame(rows, "m long, a long")
    comp = S.components(df, "m", "a")
    got = {}
    for x in comp.collect():
        got.setdefault(x["component"], set()).add(x["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(k == min(v) for k, v in got.items())
    pairs = {tuple(x) for x in S.component_pairs(comp, hot_rows=50, salts=4).collect()}
    assert pairs == {(a, b) for v in want.values() for a in v for b in v if a < b}
    assert S.components(df.where("false"), "m", "a").count() == 0 and S.hash_to_min(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 1


def test_splits_hold_components_and_shares(spark):
    r = random.Random(8)
    rows = [(c, r.choice(["pos", "neg", "neutral", None])) for c in range(3000) for _ in range(r.choice([1, 1, 2, 5]))] + [(5000, "pos")] * 700
    df = spark.createDataFrame(rows, "component long, s string")
    shares = {"train": 0.7, "validation": 0.1, "test": 0.2}
    got = S.assign_splits(df, "component", "s", shares).collect()
    assert len(got) == 3001 and sorted(map(tuple, got)) == sorted(map(tuple, S.assign_splits(df.repartition(7), "component", "s", shares).collect()))
    split = {x["component"]: x["split"] for x in got}
    for label in ("pos", "neg", None, "all"):
        own = [c for c, s in rows if label == "all" or s == label]
        for name, share in shares.items():
            assert abs(sum(split[c] == name for c in own) / len(own) - share) < 0.035
    assert S.assign_splits(df.where("false"), "component", "s", shares).count() == 0


def test_components_that_are_not_stable_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        S.hash_to_min(path, max_rounds=2)
    assert S.hash_to_min(path).select("component").distinct().count() == 1


def test_new_components_move_no_others_under_a_given_seed(spark):
    rows = [(c, f"label {c % 200}") for c in range(500)]
    shares = {"train": 0.7, "validation": 0.1, "test": 0.2}
    some = {x["component"]: x["split"] for x in S.assign_splits(spark.createDataFrame(rows[:300], "component long, s string"), "component", "s", shares, seed=5).collect()}
    more = {x["component"]: x["split"] for x in S.assign_splits(spark.createDataFrame(rows, "component long, s string"), "component", "s", shares, seed=5).collect()}
    assert len(some) == 300 and len(more) == 500 and all(more[c] == s for c, s in some.items())


def test_quota_sample(spark):
    rows = [(y, f"k{y}-{i % n}") for y, n in ((2020, 900), (2021, 30), (2022, 5)) for i in range(1000)] + [(None, "x"), (2020, None), (2020, ""), (2099, "no target")]
    df = spark.createDataFrame(rows, "year int, key string")
    targets = U.targets_from_counts(spark.createDataFrame([(2020, 500), (2020, 500), (2021, 400), (2022, 50), (2023, 50)], "year int, n int"), "year", "n", 400.0)
    sample, report = U.quota_sample(df, targets, "year", "key", minimum=25, most_gap=1.0)
    r = {x["category"]: (x["target"], x["available"], x["quota"], x["taken"], x["exhausted"]) for x in report.collect()}
    assert r == {2020: (200.0, 900, 200, 200, False), 2021: (160.0, 30, 160, 30, True), 2022: (20.0, 5, 25, 5, True), 2023: (20.0, 0, 25, 0, True)}
    s = sorted(map(tuple, sample.collect()))
    assert len(s) == len(set(s)) == 235 and s == sorted(map(tuple, U.quota_sample(df.repartition(9), targets, "year", "key", minimum=25, most_gap=1.0)[0].collect()))
    items = {x["item"]: (x["priority"], x["item"]) for x in U.distinct_items(df, "year", "key", 42).where("category = 2020").collect()}
    assert {k for y, k in s if y == 2020} == {k for _, k in sorted(items.values())[:200]}  # exactly the least priorities
    empty, rep = U.quota_sample(df.where("false"), targets, "year", "key")
    assert empty.count() == 0 and all(x["available"] == 0 for x in rep.collect())


def test_quotas_are_lowered_until_the_shares_hold():
    got = U.feasible({1: 500.0, 2: 500.0}, {1: 5000, 2: 100}, 10, 0.02)
    assert got[2] == 100 and abs(got[1] / (got[1] + got[2]) - 0.5) <= 0.02
    assert U.feasible({1: 500.0, 2: 500.0}, {1: 5000, 2: 5000}, 10, 0.02) == {1: 500, 2: 500}
    assert U.feasible({1: 5.0, 2: 0.0}, {1: 9, 2: 40}, 3, 1.0) == {1: 5, 2: 3} and U.feasible({}, {}, 3, 0.1) == {}
