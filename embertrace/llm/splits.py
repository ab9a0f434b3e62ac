"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.session import cut


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for undirected ``edges`` (a, b).

    Clusters are kept as rows (v, u): "v knows u", never as arrays.  In each round node v sends its whole cluster
    to its minimum and the minimum to its whole cluster, until no row changes: O(log n) rounds.  Known rows are
    combined map-side; a hub's rows are spread by AQE's skew join, since the only join is on v against one row per v.
    Components that aren't stable after ``max_rounds`` are an error, never a result.
    Self-loops and repeated edges are harmless; null ends are ignored.  Each round is checkpointed.
    """
    e = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
    loops = both.select("v", F.col("v").alias("u"))
    known = cut(both.unionByName(loops).distinct())
    before = now = None
    for _ in range(max_rounds):
        least = known.groupBy("v").agg(F.min("u").alias("m"))
        x = known.join(least, "v")
        # one pass over x gives both messages; at a fixed point every cluster is {v, m} or, at the minimum, the component
        known = cut(x.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*").distinct())
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before, now = now, None
    if now is None:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds; allow more")
    return known.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def entity_edges(df: DataFrame, node: str, entity: str, unknown: Sequence = (0,)) -> DataFrame:
    """Edges (a, b) that tie the nodes of one entity: a star around the entity's least node, never all pairs."""
    r = df.select(F.col(node).alias("b"), F.col(entity).alias("e")).where("b IS NOT NULL")
    ties = r.where(F.col("e").isNotNull() & ~F.col("e").isin(list(unknown))).distinct()
    hub = ties.groupBy("e").agg(F.min("b").alias("a"))
    return ties.join(hub, "e").select("a", "b").where("a <> b").distinct()


def components(df: DataFrame, node: str, entity: str, unknown: Sequence = (0,)) -> DataFrame:
    """node, component for every node with an edge or without (its own component)."""
    c = hash_to_min(entity_edges(df, node, entity, unknown))
    nodes = df.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct()
    return nodes.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def rendezvous(seed, component: str, weights: dict):
    """The split with the greatest score -weight / ln(u(seed, split, component)): no state, no order."""
    best = None
    for s in sorted(weights):
        u = (F.shiftrightunsigned(F.xxhash64(seed, F.lit(s), component), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        score = F.struct((-weights[s] / F.log(u)).alias("score"), F.lit(s).alias("split"))
        best = score if best is None else F.greatest(best, score)
    return best["split"]


def _counts(placed: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows by label and split, as columns n0, n1, ..., with the label's total; placed: split and mix."""
    x = placed.select(*by, "split", F.explode("mix").alias("m"))
    sums = [F.sum(F.when(F.col("split") == s, F.col("m.n")).otherwise(0)).alias(f"n{k}") for k, s in enumerate(names)]
    return x.groupBy(*by, F.col("m.label").alias("label")).agg(*sums, F.sum("m.n").alias("total"))


def _gap(shares: dict[str, float], names: list[str]):
    """Rows too many or too few, over all labels and over all rows."""
    of = lambda n, total: sum((F.abs(n(k) - F.lit(float(shares[s])) * total) for k, s in enumerate(names)), F.lit(0.0))
    return F.sum(of(lambda k: F.col(f"n{k}"), F.col("total"))) + of(lambda k: F.sum(f"n{k}"), F.sum("total"))


def assign_splits(
    rows: DataFrame, component: str, label: str, shares: dict[str, float], seed: int | None = None, seeds: int = 64, rounds: int = 4
) -> DataFrame:
    """component, n, split: proportions ``shares`` (which sum to 1) of the rows, with about the same mix of ``label``.

    Every component, large or small, goes by weighted rendezvous hashing.  What hashing alone leaves unequal, because components
    differ in size and mix, is corrected in two steps that are the same at every size.  Of ``seeds`` seeds of the hash the one with the least
    gaps is taken (one aggregation tries them all).  Then the weights of the splits are fitted for each label, ``rounds`` times, by the ratio of
    wanted to present rows (components weigh by their most frequent label), and the round with the least gaps is kept.
    With a given ``seed`` neither step is done: a component's split then depends on nothing else, and new components move no others.
    Null labels are a label of their own; rows with a null component get no split.
    """
    names = sorted(shares)
    plain = {s: F.lit(float(shares[s])) for s in names}
    r = rows.select(F.col(component).alias("component"), F.coalesce(F.lower(F.trim(F.col(label).cast("string"))), F.lit("")).alias("label")).where("component IS NOT NULL")
    mixes = r.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    comp = mixes.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("main"), F.collect_list(F.struct("label", "n")).alias("mix"))
    if seed is not None:
        return comp.select("component", "n", rendezvous(F.lit(int(seed)), "component", plain).alias("split"))
    comp = cut(comp)  # a row a component, with as many entries as it has labels
    trial = comp.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("split", rendezvous(F.col("seed"), "component", plain))
    first = _counts(trial, ["seed"], names).groupBy("seed").agg(_gap(shares, names).alias("gap")).orderBy("gap", "seed").first()
    chosen = F.lit(first["seed"] if first else 0)
    weights = cut(comp.select(F.explode("mix.label").alias("main")).distinct().select("main", *[plain[s].alias(f"w{k}") for k, s in enumerate(names)]))
    own = {s: F.col(f"w{k}") for k, s in enumerate(names)}
    best = None
    for k in range(rounds + 1):
        got = cut(_counts(comp.join(weights, "main").withColumn("split", rendezvous(chosen, "component", own)), [], names))
        gap = got.agg(_gap(shares, names)).first()[0] or 0.0
        if best is None or gap < best[0]:
            best = gap, weights
        if k < rounds:
            want = [F.lit(float(shares[s])) * F.col("total") for s in names]
            weights = cut(weights.join(got.withColumnRenamed("label", "main"), "main").select(
                "main", *[(F.col(f"w{i}") * F.least(F.lit(2.0), F.greatest(F.lit(0.5), want[i] / F.greatest(F.col(f"n{i}"), F.lit(0.5))))).alias(f"w{i}") for i in range(len(names))]))
    return comp.join(best[1], "main").select("component", "n", rendezvous(chosen, "component", own).alias("split"))


def component_pairs(comp: DataFrame, hot_rows: int = 2000, salts: int = 16) -> DataFrame:
    """All pairs (a < b) of nodes of one component; large components are salted on one side."""
    sized = comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component")
    hot = F.col("n") > hot_rows
    a = sized.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).otherwise(0))
    b = sized.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    b = b.select("component", "salt", F.col("node").alias("b"))
    return a.join(b, ["component", "salt"]).where("node < b").select(F.col("node").alias("a"), "b")
