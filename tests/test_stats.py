import math
import random

import pytest
from pyspark.sql import functions as F

from embertrace.operators import agreement as G
from embertrace.operators import evaluate as E
from embertrace.operators import sampling as N
from embertrace.operators import series as A
from embertrace.operators import stats as S


def midranks(xs):
    s = sorted(xs)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in xs]


@pytest.fixture(scope="module")
def groups(spark):
    r = random.Random(4)
    rows = [(g, float(r.randint(0, 12) + i)) for i, g in enumerate("abc") for _ in range(30 + 5 * i)] + [("d", 1.0)] * 4 + [("a", None), (None, 2.0), ("b", float("nan"))]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_rank_tests_against_direct_formulas(groups):
    rows, df = groups
    ok = [(g, v) for g, v in rows if g in ("a", "b", "c") and v is not None and v == v]
    for r in S.pairwise(df, "g", "v").collect():
        a, b = ([v for g, v in ok if g == x] for x in (r["group_a"], r["group_b"]))
        ranks = midranks(a + b)
        u = sum(ranks[: len(a)]) - len(a) * (len(a) + 1) / 2
        assert abs(r["u"] - u) < 1e-9 and abs(r["rank_biserial"] - (1 - 2 * u / (len(a) * len(b)))) < 1e-12
    k = S.kruskal(df, "g", "v").first()
    ranks = midranks([v for _, v in ok])
    n = len(ok)
    h = 12 / (n * (n + 1)) * sum(sum(x for x, (g, _) in zip(ranks, ok, strict=True) if g == q) ** 2 / sum(g == q for g, _ in ok) for q in "abc") - 3 * (n + 1)
    vs = [v for _, v in ok]
    h /= 1 - sum(vs.count(v) ** 3 - vs.count(v) for v in set(vs)) / (n**3 - n)
    assert k["k"] == 3 and k["n"] == n and abs(k["h"] - h) < 1e-9
    assert S.mann_whitney(df, "g", "v").count() == 0  # three groups


def test_spearman_guard_and_value(spark):
    pts = [(float(i), float((i * 7) % 31)) for i in range(30)]
    d = S.spearman(spark.createDataFrame(pts, "x double, y double"), "x", "y").first()
    rx, ry = midranks([p[0] for p in pts]), midranks([p[1] for p in pts])
    mx = sum(rx) / 30
    rho = sum((a - mx) * (b - mx) for a, b in zip(rx, ry, strict=True)) / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - mx) ** 2 for b in ry))
    assert abs(d["rho"] - rho) < 1e-12
    assert S.spearman(spark.createDataFrame(pts[:29], "x double, y double"), "x", "y").first()["rho"] is None


def test_chi_square(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5 + [(None, "x")]
    c = S.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    obs, rs, cs, n = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}, {"a": 30, "b": 35}, {"x": 40, "y": 25}, 65
    want = sum((abs(o - rs[i] * cs[j] / n) - 0.5) ** 2 / (rs[i] * cs[j] / n) for (i, j), o in obs.items())
    assert c["dof"] == 1 and abs(c["chi2"] - want) < 1e-9
    wide = spark.createDataFrame([(x, y) for x in "abc" for y in "xy" for _ in range(3)] + [("c", "z")] * 4, "a string, b string")
    assert S.chi_square(wide, "a", "b").first()["dof"] == 4  # with cells that don't occur
    assert S.chi_square(spark.createDataFrame([("a", "x")], "a string, b string"), "a", "b").count() == 0


def test_benjamini_hochberg(spark):
    p = [0.01, None, 0.04, 0.03, 0.5, 0.03]
    d = S.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()
    known = sorted(x for x in p if x is not None)
    for r in d:
        if r["p"] is None:
            assert r["p_adj_bh"] is None and r["significant_bh"] is False
        else:
            first = max(i + 1 for i, x in enumerate(known) if x == r["p"])
            assert abs(r["p_adj_bh"] - min(min(1, 5 * known[j] / (j + 1)) for j in range(first - 1, 5))) < 1e-12


def test_trends(spark):
    r = random.Random(1)
    vs = [i * 0.3 + r.random() * 4 for i in range(40)]
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate(vs)] + [("t", i, 1.0) for i in range(3)], "n string, i int, v double")
    got = {x["n"]: x for x in S.mann_kendall(s.withColumnRenamed("n", "name"), "name", "i", "v").withColumnRenamed("n", "count").withColumnRenamed("name", "n").collect()}
    want = sum((vs[j] > vs[i]) - (vs[j] < vs[i]) for i in range(40) for j in range(i + 1, 40))
    assert got["s"]["s"] == want and got["s"]["trend"] == "increasing" and got["t"]["trend"] == "insufficient"

    def ssr(pts):
        n, mx, my = len(pts), sum(x for x, _ in pts) / len(pts), sum(y for _, y in pts) / len(pts)
        sxx, sxy, syy = sum((x - mx) ** 2 for x, _ in pts), sum((x - mx) * (y - my) for x, y in pts), sum((y - my) ** 2 for _, y in pts)
        return syy - sxy**2 / sxx if n else 0

    pts = list(enumerate(vs))
    f = ((ssr(pts) - ssr(pts[:15]) - ssr(pts[15:])) / 2) / ((ssr(pts[:15]) + ssr(pts[15:])) / 36)
    long = s.where("n = 's'").withColumnRenamed("n", "name")
    assert abs(S.chow(long, "name", "i", "v", 15).first()["f_statistic"] - f) < 1e-8
    assert S.chow(long, "name", "i", "v", 2).first()["f_statistic"] is None and S.chow(long, "name", "i", "v", 38).first()["f_statistic"] is None


def test_published_confusion(spark):
    cells = [[3, 28, 0], [43, 919, 45], [10, 1319, 25]]
    rows = [("m", i, j) for i, r in enumerate(cells) for j, n in enumerate(r) for _ in range(n)]
    m = E.multiclass_metrics(spark.createDataFrame(rows, "model string, y int, p int"), ["model"], "y", "p").first()
    for name, want in (("accuracy", 0.3959030100), ("macro_f1", 0.2218807303), ("macro_recall", 0.3426165742), ("mcc", -0.0877375052)):
        assert abs(m[name] - want) < 1e-9


def test_curves_with_ties(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.1)], "y int, s double")
    c = E.score_curves(d, "y", "s").first()
    assert abs(c["average_precision"] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12 and abs(c["auc"] - (2.5 + 2) / 6) < 1e-12
    assert E.score_curves(spark.createDataFrame([(0, 0.9)], "y int, s double"), "y", "s").first()["auc"] is None


def test_threshold_tuning(spark):
    rows = [("a", 1, 0.62)] * 5 + [("a", 0, 0.3)] * 5 + [("b", 1, 0.9)] * 4 + [("b", 0, 0.1)]
    got = {r["l"]: r["threshold"] for r in E.tune_threshold(spark.createDataFrame(rows, "l string, y int, s double"), ["l"], "y", "s").collect()}
    assert got == {"a": 0.31, "b": 0.5}  # the lowest of equals; too few positives


def test_bootstrap_is_near_the_normal_interval(spark):
    d = spark.createDataFrame([(1, 1)] * 700 + [(1, 0)] * 300, "y int, p int")
    b = E.bootstrap_metrics(d, "y", "p", resamples=600).where("metric = 'accuracy'").first()
    sd = math.sqrt(0.21 / 1000)
    assert abs(b["mean"] - 0.7) < 0.003 and abs(b["lo"] - (0.7 - 1.96 * sd)) < 0.006 and abs(b["hi"] - (0.7 + 1.96 * sd)) < 0.006


def test_agreement(spark):
    rows = [(i, r, int((i + (r == "c" and i % 3 == 0)) % 2)) for i in range(12) for r in "abc"] + [(50, "a", 1), (51, "a", None)]
    v = G.votes(spark.createDataFrame(rows, "item int, rater string, value int"), ["item"], "rater", "value")
    k = {(r["a"], r["b"]): r["kappa"] for r in G.cohen_kappa(v, ["item"]).collect()}
    assert k[("a", "b")] == 1.0 and abs(k[("a", "c")] - 1 / 3) < 1e-9
    same = G.votes(spark.createDataFrame([(i, r, 1) for i in range(4) for r in "ab"], "item int, rater string, value int"), ["item"], "rater", "value")
    assert G.cohen_kappa(same, ["item"]).first()["kappa"] is None and G.krippendorff_alpha(same, ["item"]).first()["alpha"] is None
    ref, canon = (G.krippendorff_alpha(v, ["item"], m).first()["alpha"] for m in ("reference", "canonical"))
    assert ref > canon
    m = {r["item"]: (r["consensus"], r["confidence"]) for r in G.majority(G.votes(spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "z"), (2, "b", "y"), (2, "c", "x"), (3, "b", "q")], "item int, rater string, value string"), ["item"], "rater", "value"), ["item"]).collect()}
    assert m == {1: ("x", "majority"), 2: ("z", "adjudicated"), 3: ("q", "unanimous")}
    assert [(r["panel"], r["n_items"]) for r in G.fleiss_kappa(v, ["item"]).collect()] == [("a,b,c", 12)]


def test_sampling(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 10 + ["b"] * 50 + ["c"] * 51 + ["d"] * 900 + [None])]
    d = spark.createDataFrame(rows, "id int, s string")
    a = {r["s"]: r["alloc"] for r in N.allocation(d.na.drop(), ["s"], 400, 50).collect()}
    assert a["a"] == 10 and a["b"] == 50 and a["c"] == 50 and a["d"] == 50 + round(240 * 850 / 851)
    x, y = (sorted(r["id"] for r in N.stratified_sample(d, ["s"], "id", 400).collect()) for _ in range(2))
    assert x == y and len(x) == len(set(x)) == sum(a.values())
    counts = spark.createDataFrame([("neg", 102), ("neu", 3357), ("pos", 4512)], "s string, n long")
    assert {r["s"]: r["held"] for r in N.split_sizes(counts, "s", 0.3).collect()} == {"neg": 31, "neu": 1007, "pos": 1354}
    over = N.oversample(d, "s", "id", 0.3)
    assert {r["s"]: r["count"] for r in over.groupBy("s").count().collect()} == {"a": 270, "b": 270, "c": 270, "d": 900}
    assert over.where("draw > 0").select("id").distinct().count() > 40
    w = {r["s"]: r["weight"] for r in N.class_weights(spark.createDataFrame([("x",)] * 3 + [("y",)], "s string"), "s", ["x", "y", "z"]).collect()}
    assert w == {"x": 5 / 9, "y": 5 / 3, "z": 5 / 3}


def test_gap_fill_and_five_numbers(spark):
    s = spark.createDataFrame([("2020-11", 1), ("2021-02", 2)], "ym string, n int")
    assert sorted(map(tuple, A.fill_gaps(s, "ym").collect())) == [("2020-11", 1), ("2020-12", None), ("2021-01", None), ("2021-02", 2)]
    f = A.five_numbers(spark.createDataFrame([("a", float(i)) for i in range(5)] + [("a", None)], "g string, v double"), "g", "v").first()
    assert (f["n"], f["least"], f["q1"], f["median"], f["q3"], f["most"]) == (5, 0.0, 1.0, 2.0, 3.0, 4.0)
    assert A.label_series(spark.createDataFrame([], "ym string, m int, p string, s double, x double, t int"), F.col("ym"), "ym", "m", "p", "s", ["a"], "x", ["t"]).count() == 0
