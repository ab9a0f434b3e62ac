import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrace.llm import abuse as A
from embertrace.llm import encoding as G
from embertrace.llm import language as N
from embertrace.llm import leaks as K
from embertrace.llm import packing as P

NOUNS = "river tower bottle crown shield forest lantern bridge hammer throne sentry banner orb totem relic cliff".split()
VERBS = "carried dropped guarded stole ignored upgraded visited circled denied marked".split()
NAMES = [a + b for a in ("qua", "dro", "mel", "zin", "tor", "vex") for b in ("mor", "lin", "dak", "ria", "nush")]


def sentence(r):
    return f"{r.choice(NAMES)} quietly {r.choice(VERBS)} the {r.choice(NOUNS)} near {r.choice(NAMES)} while {r.choice(NAMES)} {r.choice(VERBS)} another {r.choice(NOUNS)}"


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, " and then ".join(sentence(r) for _ in range(4))) for i in range(30)] + [(90, "too short to leak"), (91, None), (92, "")]
    docs, want = [], set()
    for d in range(300):
        words = " ".join(sentence(r) for _ in range(r.randint(1, 8))).split()
        if d % 3 == 0:
            k = r.randrange(30)
            ws = items[k][1].split()
            n = r.choice([8, 12, 13, 20, 30])
            at = r.randrange(len(ws) - n)
            part = ws[at : at + n]
            if d % 2:
                part[n // 2] = part[n // 2][:-1] + "q" + part[n // 2][-1]
            if d % 5 == 0:
                part.insert(n // 3, "[12:34]")
                part.insert(2, ">")
            if d % 4 == 0:
                part = [w.upper() + "," for w in part]
            cut = r.randrange(len(words))
            words[cut:cut] = part
        docs.append((d, "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "filler " * 30000 + items[5][1] + " filler" * 30000)]
    spelled = {i: [w for w in map(K.word, (t or "").lower().split()) if w] for i, t in items}
    for d, t in docs:
        ws = [w for w in map(K.word, (t or "").lower().split()) if w]
        for i, iw in spelled.items():
            grid = [[0] * (len(iw) + 1) for _ in range(2)]
            best = 0
            for x in ws if len(ws) < 5000 else []:
                grid = [grid[1], [0] * (len(iw) + 1)]
                for y, b in enumerate(iw):
                    if K.near(x, b):
                        grid[1][y + 1] = grid[0][y] + 1
                        best = max(best, grid[1][y + 1])
            if best >= 12:
                want.add((d, i))
    got = {tuple(x) for x in K.leaked_items(spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got - {(903, 5)} == want and (903, 5) in got and len(want) > 50


def test_leaks_after_a_replaced_word(spark):
    words = [f"{x}{y}" for x in ("amber", "cedar", "delta", "flint", "gravel") for y in ("fall", "moor", "ness", "port", "wick")]
    docs = [(1, " ".join([*words[:5], "zzzzzz", *words[6:19]])), (2, " ".join([*words[:5], "zzzzzz", *words[6:14]]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(x) for x in K.leaked_items(d, i).collect()] == [(1, 7)]


def test_a_wrong_word_hides_no_run_wherever_it_stands(spark):
    words = [f"{x}{y}" for x in ("amber", "cedar", "delta", "flint", "gravel") for y in ("fall", "moor", "ness", "port", "wick")]
    docs = []
    for wrong in range(25):
        for shift in (0, 7, 20, 31):
            docs.append((wrong * 100 + shift, " ".join(["filler"] * shift + words[:wrong] + ["zzzzzz"] + words[wrong + 1 : 21])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[::-1]))], "item_id long, text string")
    assert {x["doc_id"] for x in K.leaked_items(d, i).collect()} == {i for i, _ in docs if max(i // 100, 20 - i // 100) >= 12}


def test_latent_candidates_find_short_runs_without_any_seed(spark):
    r = random.Random(31)
    items = [(k, " and then ".join(sentence(r) for _ in range(6))) for k in range(60)]
    docs, want = [], set()
    for d in range(200):
        k = r.randrange(60)
        ws = items[k][1].split()
        at = r.randrange(len(ws) - 12)
        around = " ".join(sentence(r) for _ in range(5)).split()
        cut = r.randrange(len(around))
        docs.append((d, " ".join(around[:cut] + ws[at : at + 12] + around[cut:])))
        want.add((d, k))
    got = K.leak_candidates(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert len(want & found) >= 0.9 * len(want) and all(x["cosine"] >= K.COSINE for x in got if x["cosine"])


def test_common_subsequences_against_the_textbook():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 9, (50, K.SPAN)), r.integers(0, 9, (50, K.SPAN))
    got = K.common_length(K.equal_bits(a[:, :, None] == b[:, None, :]))
    for x, y, n in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        row = [0] * (K.SPAN + 1)
        for c in x:
            last = row
            row = [0]
            for j, e in enumerate(y):
                row.append(last[j] + 1 if c == e else max(row[-1], last[j + 1]))
        assert row[-1] == n
    lines = K.diagonals(a[:, :, None] == b[:, None, :])
    c, g, x = np.nonzero((lines[:, :, None] >> np.arange(K.SPAN, dtype=np.uint64)) & np.uint64(1))
    assert len(c) == (a[:, :, None] == b[:, None, :]).sum() and (a[c, x] == b[c, x - g + K.SPAN - 1]).all()


def test_paraphrases_keep_their_answer(spark):
    words = [f"{x}{y}" for x in ("amber", "cedar", "delta", "flint", "gravel") for y in ("fall", "moor", "ness", "port", "wick", "mere", "dale")]
    para = [w for k, w in enumerate(words) for w in ([w, "indeed"] if k % 4 == 0 else [w])]
    docs = [(1, " ".join(para)), (2, " ".join(words)), (3, " ".join(f"other{k}" for k in range(40)))]
    got = {(x["doc_id"], x["item_id"]): x for x in K.leak_candidates(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[2, 7]["run"] >= 12 and got[1, 7]["run"] < 12 and got[1, 7]["common"] >= 0.6 and got[1, 7]["answer"] >= 0.6


def test_leaks_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    assert K.leaked_items(d, i.where("false")).count() == 0 and K.leaked_items(d.where("false"), i).count() == 0 and K.leaked_items(d, i).count() == 0


def test_run_length():
    item = [f"w{i}x" for i in range(20)]
    assert K.run_length(["a", *item[3:9], "zz", *item[9:14]], item, 2, 4, 99) == 6  # a foreign word ends it
    assert K.run_length([*item[0:5], "9", *item[5:14]], item, 1, 1, 99) == 14  # a mark doesn't
    assert K.run_length([*item[0:4], item[4] + item[5], *item[6:9], item[9][:1], item[9][1:], *item[10:12]], item, 0, 0, 99) == 12
    assert K.near("tower", "tovver") and K.near("bridge", "bridgse") and not K.near("cat", "cut") and not K.near("tower", "river")


TEXT = "la montaña está después del río y también quizás mañana", "ich hätte schon früher für den Schlüssel gekämpft", "я думаю что наша команда сломала старую башню"


def test_chains_are_undone_exactly():
    for t in TEXT:
        for chain in G.CHAINS:
            w, right, times = chain
            bad = t
            try:
                for _ in range(times):
                    raw = bad.encode("utf-8") if right == "utf-8" else bytes(G.TABLES[right][0][c] for c in bad)
                    bad = "".join(G.TABLES[w][1][b] for b in raw)
            except KeyError:
                continue
            assert G.undo(bad, *chain) == t


def test_garbled_records_are_found_and_restored(spark):
    r = random.Random(2)
    words = [t.split() for t in TEXT]
    rows, truth = [], {}
    for i in range(600):
        ws = [r.choice(words[i % 3]) for _ in range(12)]
        good = " ".join(ws)
        rows.append((i, good, f"s{i % 4}"))
        if i % 10 == 0:
            bad = good.encode("utf-8").decode("latin-1")
            if bad != good:
                truth[i] = good
                rows[-1] = (i, bad, f"s{i % 4}")
    fine = ["½ gold × 3", "ÆØÅ ÆØÅ", "☆彡 ░▒▓ ツ", "30 € → 20 £ §4", "ÃO ÃO", "  ok then", "plain"]
    rows += [(1000 + i, t, "s1") for i, t in enumerate(fine * 3)] + [(2000, None, "s1"), (2001, "", None), (2002, "lo�st", None), (2003, "ok " * 40000 + TEXT[0].encode().decode("latin-1"), "s2")]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "id long, text string, source string, repaired string")
    got = {x["id"]: x for x in G.garbled(df, "id", "text", "source").collect()}
    assert set(got) == set(truth) | {2002, 2003}
    assert all(got[i]["repaired"] == t for i, t in truth.items()) and got[2003]["repaired"].endswith(TEXT[0]) and got[2002]["repaired"] == "lo�st" and got[2002]["chains"] == "lost"
    assert G.garbled(df.where("false"), "id", "text", "source").count() == 0 and G.garbled(df.where("text = 'plain'"), "id", "text", "source").count() == 0


def test_tokens_are_split_without_a_step_for_each_character():
    text = "".join(f"plain words, más\u00e9\xa0x a\xa0b {k}\t\xa0\xa0é\r\nÐ°\xa0 ok " for k in range(20_000))
    spaced = "".join(" " if c in "\n\t\r" or (c == "\xa0" and before.isascii()) else c for before, c in zip("\xa0" + text, text, strict=False))
    assert G.rare_tokens(text) == [t for t in spaced.split(" ") if not t.isascii()]
    text = text.replace("\xa0", "")

    def took(f):
        times = []
        for _ in range(5):
            start = time.process_time()
            f()
            times.append(time.process_time() - start)
        return min(times)

    assert took(lambda: G.rare_tokens(text)) < 0.5 * took(lambda: text.translate(str.maketrans("\n\t\r", "   ")))


def test_garbled_tokens_are_settled_once_for_all_records_of_a_pool():
    class Counted(G.Model):
        asked = 0

        def posterior(self, token, prior):
            self.asked += 1
            return super().posterior(token, prior)

    two, one = np.zeros(G.BINS), np.zeros(G.BINS)
    for t in " ".join(TEXT).split():
        b, a = G._bigrams(t)
        np.add.at(two, b, 100.0)
        np.add.at(one, np.array(a) % G.BINS, 100.0)
    m, memory = Counted(two, one), {}
    good = "mañana\t" + TEXT[0] + " \n\r " + TEXT[0] + "\xa0\r"
    bad = good.replace("\xa0", "").encode().decode("latin-1") + "\xa0"
    want = good.replace("\xa0", "") + "\xa0"
    for k in range(20):
        chains, repaired, _ = G.judge(f"{bad}{k}", G.Model.first(), m, memory)
        assert "latin-1>utf-8" in chains and repaired == f"{want}{k}"
    assert 0 < m.asked <= len(set(G.rare_tokens(bad)))


def sentences(lang, r, n):
    bank = {"en": "the quiet river went over that broken bridge when nobody was looking because we should have taken it".split(), "de": "der kleine fluss ging über die kaputte brücke als keiner hinsah weil wir es nehmen mussten und nicht".split(),
            "es": "el río pequeño pasó por la puente rota cuando nadie miraba porque nosotros debimos tomarla después".split(), "ru": "я думаю что наша команда потом сломала старую башню когда никто не смотрел".split()}[lang]
    return " ".join(r.choice(bank) for _ in range(n))


def test_languages_held_out_and_mixed(spark):
    r = random.Random(9)
    rows, truth = [], {}
    for i in range(900):
        lang = ("en", "de", "es", "ru")[i % 4]
        rows.append((i, sentences(lang, r, 9), lang if i % 9 else ("en", "de", None, "und")[i % 4]))
        truth[i] = [lang]
    for i in range(100):
        a, b = r.sample(["en", "de", "es", "ru"], 2)
        rows.append((5000 + i, sentences(a, r, 8) + (" ", ". ", " - ")[i % 3] + sentences(b, r, 8), a))
        truth[5000 + i] = [a, b]
    odd = [(9000, None, "en"), (9001, "", None), (9002, "12 !!", "en"), (9003, sentences("de", r, 20000), "en"), (9004, "gg", "en")]
    df = spark.createDataFrame([(*x, 1) for x in rows + odd], "id long, key string, lang string, segment int")
    found = {}
    for x in N.identified(df, "id", "key", "lang").collect():
        found.setdefault(x["id"], []).append((x["segment"], x["lang"], x["n_words"], x["confidence"]))
    right = sum([s[1] for s in sorted(found[i])] == t for i, t in truth.items())
    assert right / len(truth) > 0.97 and set(found) == set(truth) | {9000, 9001, 9002, 9003, 9004}
    assert found[9000] == [(0, None, 0, 0.0)] and found[9003][0][1] == "de" and found[9003][0][2] == 20000 and 0 < found[9004][0][3] < 1
    cases = {tuple(x) for x in N.label_cases(N.identified(df, "id", "key", "lang"), df, "id", "lang").collect()}
    want = {(i, t[-1]) for i, t in truth.items() if i >= 5000} | {(i, truth[i][0]) for i, _, l in rows if i < 5000 and l != truth[i][0]} | {(9003, "de")}
    assert len(cases ^ want) / len(want) < 0.06


def test_forward_sums_all_segmentations():
    pieces = {p: np.full(len(N.LANGUAGES), w) for p, w in (("▁", 0.2), ("a", 0.3), ("b", 0.1), ("ab", 0.25), ("▁a", 0.05))}
    m = N.Unigrams(pieces, 2)
    want = 0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.05 * 0.1
    assert np.allclose(np.exp(m.score("ab")), want)
    counts = {}
    m.expect("ab", np.ones(len(N.LANGUAGES)), counts)
    assert np.allclose(counts["ab"], 0.2 * 0.25 / want) and np.allclose(counts["▁a"], 0.05 * 0.1 / want)


def test_long_words_are_read_whole():
    pieces = {p: np.full(len(N.LANGUAGES), w) for p, w in (("▁", 0.2), ("a", 0.3), ("b", 0.1), ("ab", 0.25))}
    pieces["b"][0] = 0.2
    m = N.Unigrams(pieces, 2)
    want = np.log(0.2) + 60 * np.log(0.3) + 40 * np.log(pieces["b"]) + np.log(1 + 0.25 / (0.3 * pieces["b"]))
    assert np.allclose(m.score("a" * 60 + "b" * 40), want)
    counts = {}
    m.expect("a" * 600 + "b" * 400, np.ones(len(N.LANGUAGES)), counts)
    assert np.allclose(counts["a"] + counts["ab"], 600) and np.allclose(counts["b"] + counts["ab"], 400)


def test_segments_of_empty_and_short_texts():
    assert N.segments(np.zeros((0, 7)), []) == [] and N.segments(np.eye(7)[:3], [False] * 3)[0][:2] == (0, 3)


def test_abuse_held_out(spark):
    r = random.Random(4)
    insults = ["idiot", "moron", "garbage", "clown", "coward", "loser"]
    rows = []
    for i in range(1200):
        base = sentence(r)
        if i % 4 == 0:
            w = r.choice(insults)
            w = (w, w.upper(), ".".join(w), w.replace("o", "0"), w[0] + w[1] * 4 + w[2:])[i % 5]
            base = (f"you are a {w}", f"{base} you are a {w}", f"nobody likes you {w}")[i % 3]
        rows.append((i, base, int(i % 4 == 0) if i % 3 else None))
    rows += [(9000, None, None), (9001, "", 1), (9002, sentence(r) * 2000, None), (9003, "you are a moron", None), (9004, "you are a moron", None)]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "id long, key string, y int, score double")
    got = {x["id"]: (x["score"], x["abusive"]) for x in A.scored(df, "id", "key", F.col("y") > 0).collect()}
    assert len(got) == len(rows) and got[9000] == (-9.0, False) and got[9001] == (-9.0, False) and not got[9002][1] and got[9003] == got[9004] and got[9003][1]
    held = [(got[i][1], i % 4 == 0) for i, _, y in rows if y is None and i < 9000]
    tp = sum(p and t for p, t in held)
    assert 2 * tp / (sum(p for p, _ in held) + sum(t for _, t in held)) > 0.93
    assert A.scored(df.where("false"), "id", "key", F.col("y") > 0).count() == 0
    assert [x["score"] for x in A.scored(df.where("id < 3 AND y IS NULL"), "id", "key", F.col("y") > 0).collect()] == [0.0]


def test_abuse_counts_every_unlabelled_text(spark):
    r = random.Random(5)
    rows = [(i, f"{sentence(r)} you are a {r.choice(['moron', 'clown'])}" if i % 3 == 0 else sentence(r), int(i % 3 == 0) if i < 90 else None) for i in range(150)]
    copies = [(i, "the same line again", None) for i in range(1000, 14000)]
    few, many = (spark.createDataFrame(x, "id long, key string, y int") for x in (rows + copies[:1], rows + copies))
    score = lambda df: {x["id"]: (round(x["score"], 6), x["abusive"]) for x in A.scored(df, "id", "key", F.col("y") > 0).where("id < 1000").collect()}
    assert score(few) == score(many)


def test_labels_that_contradict_each_other(spark):
    rows = [(1, 1, 0, 0, True), (2, 1, 1, 0, True), (3, 0, 1, 0, False), (4, 1, 0, 1, True), (5, 0, 0, 0, False), (6, 0, 0, 1, True), (7, None, None, None, None), (8, None, None, 1, True)]
    rows[0] = (1, 1, 0, 0, False)
    df = spark.createDataFrame(rows, "i int, general int, swearing int, insult int, want boolean")
    assert all(x["got"] == x["want"] for x in df.withColumn("got", A.consistent_label("general", ["insult", "insult"], "swearing")).collect())


def test_stretches_of_very_long_texts_and_against_all():
    r = random.Random(6)
    words = "one two three you are a clown moron near the river".split()
    c = A.Contrast([" " + " ".join(r.choice(words[:3] + words[8:]) for _ in range(5)) + " " for _ in range(40)] + [" you are a clown ", " you moron "] * 10, [0] * 40 + [1] * 20)
    texts = [" " + " ".join(r.choice(words) for _ in range(r.randint(1, 14))) + " " for _ in range(50)] + ["", " one "]
    for t, (s, lo, hi) in zip(texts, c.best_stretches(texts), strict=True):
        if not t:
            assert s == -9.0
            continue
        m = np.concatenate([[0.0], np.cumsum(c.ratios([t])[0])])
        gaps = [i for i, x in enumerate(t) if x == " "]
        every = {(a, b + 1): (m[b + 1] - m[a + 1]) / np.sqrt(b - a + A.SHORTEST) for i, a in enumerate(gaps) for b in gaps[i + 1 :]}
        assert (lo, hi) in every and abs(every[lo, hi] - s) < 1e-6 and (len(gaps) > 13 or s >= max(every.values()) - 1e-6)
    long = " " + "near the river " * 30_000
    assert np.isfinite(c.best_stretches([long])[0][0])


def test_kneser_ney_probabilities_sum_to_one():
    c = A.Contrast([" abab ", " abba ", " bbbb "], [0, 0, 1])
    assert len(c.ratios([" ab "])[0]) == 4 and c.best_stretches([])==[] and c.best_stretches([""])[0][0] == -9.0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_exactly_the_histogram(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip((r.lognormal(5.2, 1, 4000), r.uniform(1, 2048, 4000), r.choice([700, 1400, 2048], 3000), np.full(2000, 683), np.array([5.0]), r.uniform(1100, 2048, 900))[seed], 1, 2048).astype(int)
    h = {int(i): int(c) for i, c in enumerate(np.bincount(lengths)) if c}
    groups = P.plan(h)
    held = {}
    for many, content in groups:
        assert many > 0 and sum(n * c for n, c in content.items()) <= 2048
        for n, c in content.items():
            held[n] = held.get(n, 0) + many * c
    assert held == h
    bins = sum(m for m, _ in groups)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    if seed == 2:  # 700 and 1400 don't fit together
        least = h[2048] + h[1400] + -(-h[700] // 2)
    if seed == 3:  # a third document of 683 is one token too much
        least = 1000
    assert bins <= least * 1.12 + 1
    if seed == 0:
        assert lengths.sum() / (bins * 2048) > 0.995


def test_packing(spark):
    r = random.Random(1)
    rows = [(i, "word " * r.randint(1, 900)) for i in range(400)] + [(1000 + i, "same text again " * 30) for i in range(300)] + [(5000, None), (5001, ""), (5002, "long " * 9000)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, container int")
    got = P.packed(df, "doc_id", "text").collect()
    fill, pieces = {}, {}
    for x in got:
        pieces.setdefault(x["id"], []).append(x)
        if x["container"] is not None:
            fill[x["container"]] = fill.get(x["container"], 0) + x["n_tokens"]
    assert set(pieces) == {a for a, _ in rows} and max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    counts = {x["id"]: x["n"] for x in P.token_counts(df, "doc_id", "text").collect()}
    for i, ps in pieces.items():
        assert sum(p["n_tokens"] for p in ps) == counts[i] and (len(ps) == 1 or counts[i] > 2048)
        ps.sort(key=lambda p: p["piece"])
        assert all(p["n_tokens"] == 2048 for p in ps[:-1]) and [p["start_token"] for p in ps] == [2048 * k for k in range(len(ps))]
    assert pieces[5000][0]["container"] is None and len(pieces[5002]) > 1
    assert sum(fill.values()) / (2048 * len(fill)) > 0.98
    assert P.packed(df.where("false"), "doc_id", "text").count() == 0
