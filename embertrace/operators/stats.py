"""Rank, contingency and trend tests.  Statistics are lazy one-row (or few-row) plans; tail probabilities finish them.

The rank kernel never sorts rows: values are counted first (map-side), the distinct values are range partitioned, and
running counts are added to the partitions' offsets, so no step needs one task for all values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.functions import dist
from embertrace.session import cut

MOST_GROUPS = 64


def running_before(counts: DataFrame, value: str, cols: list[str]) -> DataFrame:
    """``counts`` (one row a value) plus ``before_<col>``: the sum of the column over all smaller values."""
    ranged = cut(counts.repartitionByRange(F.col(value)).withColumn("_pid", F.spark_partition_id()))
    w = Window.orderBy("_pid")  # a row per partition
    offsets = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    offsets = offsets.select("_pid", *[(F.sum(f"_t_{c}").over(w) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in cols])
    own = Window.partitionBy("_pid").orderBy(value)
    joined = ranged.join(F.broadcast(offsets), "_pid")
    return joined.select(*counts.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(own) - F.col(c)).alias(f"before_{c}") for c in cols])


def groups_of(df: DataFrame, group: str, least: int) -> list:
    """Groups with at least ``least`` rows, ascending; more than MOST_GROUPS is an error."""
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return [r[0] for r in rows]


def _prepared(df: DataFrame, group: str, value: str, least: int) -> tuple[DataFrame, list]:
    d = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    gs = groups_of(d, "g", least)
    counts = d.where(F.col("g").isin(gs)).groupBy("v").agg(*[F.count_if(F.col("g") == g).alias(f"n{i}") for i, g in enumerate(gs)])
    return running_before(counts, "v", [f"n{i}" for i in range(len(gs))]), gs


def _pair_aggs(i: int, j: int) -> list[Column]:
    a, b = F.col(f"n{i}").cast("double"), F.col(f"n{j}").cast("double")
    c = a + b
    return [F.sum(a).alias("n1"), F.sum(b).alias("n2"), F.sum(a * (F.col(f"before_n{j}") + b / 2)).alias("u"), F.sum(c * c * c - c).alias("ties")]


def _finish_pair(d: DataFrame, a, b) -> DataFrame:
    n = F.col("n1") + F.col("n2")
    big = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (big - F.col("n1") * F.col("n2") / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    return d.select(F.lit(str(a)).alias("group_a"), F.lit(str(b)).alias("group_b"), F.col("n1").cast("long").alias("n_a"), F.col("n2").cast("long").alias("n_b"),
                    F.col("u"), z.alias("z"), (1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))).alias("rank_biserial"))


def mann_whitney(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row for exactly two groups (ascending; U belongs to the first); empty otherwise or with a group under ``least`` rows."""
    return pairwise(df, group, value, least, exactly_two=True)


def pairwise(df: DataFrame, group: str, value: str, least: int = 5, exactly_two: bool = False) -> DataFrame:
    """Mann-Whitney for each pair of groups: U, z (ties and continuity corrected), two-sided p (not adjusted), rank-biserial effect."""
    d, gs = _prepared(df, group, value, least)
    if exactly_two and len(gs) != 2:
        gs = []
    out = None
    for i, j in combinations(range(len(gs)), 2):
        one = _finish_pair(d.agg(*_pair_aggs(i, j)), gs[i], gs[j])
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = df.sparkSession.createDataFrame([], "group_a string, group_b string, n_a long, n_b long, u double, z double, rank_biserial double")
    return out.withColumn("p_value", dist.tail(dist.normal_two_sided, F.col("z")))


def kruskal(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row: k, n, H (tie corrected), p, epsilon squared.  Groups under ``least`` rows are left out before ranking."""
    d, gs = _prepared(df, group, value, least)
    k = len(gs)
    ns, before = [F.col(f"n{i}").cast("double") for i in range(k)], [F.col(f"before_n{i}") for i in range(k)]
    c = sum(ns, F.lit(0.0))
    rank = sum(before, F.lit(0.0)) + (c + 1) / 2
    s = d.agg(F.sum(c).alias("n"), F.sum(c * c * c - c).alias("ties"), *[F.sum(x * rank).alias(f"r{i}") for i, x in enumerate(ns)], *[F.sum(x).alias(f"m{i}") for i, x in enumerate(ns)])
    n = F.col("n")
    h = (F.lit(12.0) / (n * (n + 1)) * sum((F.col(f"r{i}") ** 2 / F.col(f"m{i}") for i in range(k)), F.lit(0.0)) - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = s.select(F.lit(k).alias("k"), n.cast("long").alias("n"), h.alias("h")).where(F.lit(k >= 2))
    return out.select("k", "n", "h", ((F.col("h") - k + 1) / (F.col("n") - k)).alias("epsilon_squared"), dist.tail(dist.chi2_sf, F.col("h"), F.lit(float(k - 1))).alias("p_value"))


def midranks(df: DataFrame, value: str, out: str = "midrank") -> DataFrame:
    """value, n, midrank for each distinct value; nulls and NaN take no part."""
    c = df.select(F.col(value).alias(value)).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running_before(c, value, ["n"]).select(value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str, least: int = 30) -> DataFrame:
    """One row: n, rho, p (Student t); rho is null for fewer than ``least`` rows.  Equal pairs are counted before ranking."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    c = cut(d.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    rank = lambda v: running_before(c.groupBy(v).agg(F.sum("w").alias("n")), v, ["n"]).select(v, (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"r{v}"))
    j = c.join(rank("x"), "x").join(rank("y"), "y")
    # the mean of mid-ranks is (n + 1) / 2 whatever the ties
    m2 = F.col("n") * ((F.col("n") + 1) / 2) ** 2
    s = j.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("pxy"), F.sum(F.col("w") * F.col("rx") ** 2).alias("pxx"), F.sum(F.col("w") * F.col("ry") ** 2).alias("pyy"))
    s = s.select("n", (F.col("pxy") - m2).alias("sxy"), (F.col("pxx") - m2).alias("sxx"), (F.col("pyy") - m2).alias("syy"))
    rho = F.when(F.col("n") >= least, F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0)))
    out = s.select(F.col("n").cast("long").alias("n"), rho.alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest((1 - F.col("rho")) * (1 + F.col("rho")), F.lit(1e-300)))
    return out.withColumn("p_value", dist.tail(dist.t_two_sided, t, (F.col("n") - 2).cast("double")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, dof, chi2 (Yates at dof 1), Cramer's V, p; empty without two rows and two columns.

    The sum over the full grid, empty cells too, is sum(o^2 / e) - n, so no grid is built.
    """
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o")).where("a IS NOT NULL AND b IS NOT NULL")
    m = c.withColumns({"r": F.sum("o").over(Window.partitionBy("a")), "k": F.sum("o").over(Window.partitionBy("b"))})
    one_a = F.row_number().over(Window.partitionBy("a").orderBy("b")) == 1
    one_b = F.row_number().over(Window.partitionBy("b").orderBy("a")) == 1
    m = m.withColumns({"one_a": one_a, "one_b": one_b})
    x = m.agg(
        F.sum("o").alias("n"), F.sum(F.col("o") ** 2 / (F.col("r") * F.col("k"))).alias("q"), F.max_by(F.struct("o", "r", "k"), F.struct("a", "b")).alias("c"),
        F.count_if("one_a").alias("rows"), F.count_if("one_b").alias("cols"), F.sum(F.when(F.col("one_a"), 1 / F.col("r"))).alias("ir"), F.sum(F.when(F.col("one_b"), 1 / F.col("k"))).alias("ic"))
    x = x.where("rows > 1 AND cols > 1").select("*", "c.o", "c.r", "c.k")
    n, e = F.col("n"), F.col("r") * F.col("k") / F.col("n")
    off = F.abs(F.col("o") - e)
    yates = (off - F.least(F.lit(0.5), off)) ** 2 * n * F.col("ir") * F.col("ic")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    x = x.select(n.cast("long").alias("n"), dof.alias("dof"), F.when(dof == 1, yates).otherwise(n * F.col("q") - n).alias("chi2"), F.least(F.col("rows"), F.col("cols")).alias("side"))
    return x.select("n", "dof", "chi2", F.sqrt(F.col("chi2") / (F.col("n") * (F.col("side") - 1))).alias("cramers_v"), dist.tail(dist.chi2_sf, F.col("chi2"), F.col("dof").cast("double")).alias("p_value"))


def benjamini_hochberg(tests: DataFrame, p: str, q: float = 0.05, prefix: str = "bh") -> DataFrame:
    """Adjusted p and significance; null p stays null and not significant.  For tables of test results (one sort)."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(known)
    m, rank = F.count(p).over(w), F.row_number().over(w.orderBy(p))
    d = tests.withColumn("_raw", F.when(known, F.least(F.lit(1.0), F.col(p) * m / rank))).withColumn("_rank", rank)
    adj = F.min("_raw").over(Window.partitionBy(F.col(p).isNotNull()).orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn(f"p_adj_{prefix}", adj).withColumn(f"significant_{prefix}", F.coalesce(F.col(f"p_adj_{prefix}") <= q, F.lit(False))).drop("_raw", "_rank")


def mann_kendall(series: DataFrame, name: str, index: str, value: str) -> DataFrame:
    """Per series: n, S, tau, z, p, trend (at 5 %); fewer than four values are 'insufficient'.  Variance without tie term.

    A series is an ordered vector of at most a few thousand periods; pairs are compared inside one array.
    """
    d = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("vs"))
    s = F.aggregate(F.sequence(F.lit(1), F.size("vs")), F.lit(0.0), lambda acc, i: acc + F.aggregate(
        F.slice("vs", i + 1, F.greatest(F.size("vs") - i, F.lit(0))), F.lit(0.0), lambda t, v: t + F.signum(v - F.element_at(F.col("vs"), i))))
    d = d.select(name, F.size("vs").alias("n"), s.alias("s"))
    n = F.col("n").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    d = d.withColumns({"tau": F.when(F.col("n") >= 4, F.col("s") / (n * (n - 1) / 2)), "z": F.when(F.col("n") >= 4, z)})
    d = d.withColumn("p_value", dist.tail(dist.normal_two_sided, F.col("z")))
    return d.withColumn("trend", F.when(F.col("n") < 4, "insufficient").when(F.col("p_value") >= 0.05, "no trend").when(F.col("z") > 0, "increasing").otherwise("decreasing"))


def chow(series: DataFrame, name: str, index: str, value: str, breakpoint: int) -> DataFrame:
    """Per series: F of one line against two, split before ``breakpoint``; null outside 3..n-3 or without residual variance."""
    d = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x, y = F.col(index).cast("double"), F.col(value).cast("double")

    def ssr(cond: Column | None) -> Column:
        xx, yy = (x, y) if cond is None else (F.when(cond, x), F.when(cond, y))
        return F.regr_syy(yy, xx) - F.regr_sxy(yy, xx) ** 2 / F.nullif(F.regr_sxx(yy, xx), F.lit(0.0))

    left = F.col(index) < breakpoint
    g = d.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if(left).alias("n1"), ssr(None).alias("s"), ssr(left).alias("s1"), ssr(~left).alias("s2"))
    rest = F.col("s1") + F.col("s2")
    f = F.when((F.col("n1") >= 3) & (F.col("n") - F.col("n1") >= 3) & (F.col("n") > 4) & (rest > 0), ((F.col("s") - rest) / 2) / (rest / (F.col("n") - 4)))
    out = g.select(name, F.lit(breakpoint).alias("breakpoint"), "n", f.alias("f_statistic"))
    return out.withColumn("p_value", dist.tail(dist.f_sf, F.col("f_statistic"), F.lit(2.0), (F.col("n") - 4).cast("double")))
