"""Filling fixed-capacity containers with documents: pattern packing by non-negative least squares.

Lengths are exact token counts; a document above the capacity is cut into full pieces and a rest, all others stay whole.
Everything but the final placement works on the histogram of lengths, whose size is the capacity whatever the data:

1. patterns are enumerated: multisets of up to three different length steps (with repeats) that fill a container;
2. non-negative least squares fits how often each pattern is used to the histogram, and the counts are rounded down;
3. exact lengths are dealt to the patterns' places, longest first;
4. what is left (and the room that rounding up to steps left) is packed by best fit, longest first, on groups
   of containers with the same content.

Placement is distributed: a document's rank among those of its length (a running count over hash shards, so a length that
a third of all documents share is no single task) picks its place in the plan.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.session import cut

CAPACITY = 2048
STEPS = 64
RANK_BITS = 44  # ranks of documents of one length
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str, text: str, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id, n: tokens of the whole text by a public byte-level vocabulary; null and empty texts have 0."""
    kind = df.schema[id_col].dataType.simpleString()
    with open(f"{folder}/{vocabulary}", "rb") as file:  # read here and shipped: executors need no such folder
        shipped = df.sparkSession.sparkContext.broadcast(file.read())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "n": [len(coder.encode_ordinary(t)) if t else 0 for t in f["t"]]})

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInPandas(count, f"id {kind}, n long")


def patterns(steps: int = STEPS) -> np.ndarray:
    """Rows of counts by step size 1..steps: up to three different sizes, with repeats, that sum to ``steps``."""
    out: list[dict[int, int]] = []

    def extend(pattern: dict[int, int], room: int, largest: int) -> None:
        if room == 0:
            out.append(dict(pattern))
            return
        if len(pattern) == 3:
            return
        sizes = range(min(largest, room), 0, -1) if len(pattern) < 2 else [s for s in range(min(largest, room), 0, -1) if room % s == 0]
        for s in sizes:
            for c in range(room // s, 0, -1) if len(pattern) < 2 else (room // s,):
                pattern[s] = c
                extend(pattern, room - s * c, s - 1)
                del pattern[s]

    extend({}, steps, steps)
    rows = np.zeros((len(out), steps), dtype=np.float32)
    for i, p in enumerate(out):
        for s, c in p.items():
            rows[i, s - 1] = c
    return rows


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with least |a' x - b| (a: patterns by sizes), by accelerated projected gradients."""
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / max(float(np.linalg.norm(a.T @ (a @ v))), 1e-9)
    x = y = np.zeros(a.shape[0])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a @ (a.T @ y - b)), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[int, dict[int, int]]]:
    """Groups (number of containers, {length: documents of it in each}) that hold exactly the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if not left:
        return []
    width = -(-capacity // steps)
    lengths: dict[int, list[int]] = {}
    for n in sorted(left):
        lengths.setdefault(-(-n // width), []).append(n)
    want = np.array([sum(left[n] for n in lengths.get(s, ())) for s in range(1, steps + 1)], dtype=float)
    rows = patterns(steps)
    usable = ~((rows > 0) & (want == 0)).any(axis=1)
    rows = rows[usable]
    weight = np.arange(1, steps + 1) ** 0.5  # a missed long document costs more
    counts = np.floor(nnls(rows * weight, want * weight) + 0.02).astype(int) if len(rows) else np.zeros(0, dtype=int)
    groups: list[tuple[int, dict[int, int]]] = []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        places = [s + 1 for s in range(steps) for _ in range(int(rows[i, s]))][::-1]
        todo = int(counts[i])
        while todo:
            content: dict[int, int] = {}
            for s in places:
                n = next((n for n in reversed(lengths[s]) if left[n] > content.get(n, 0)), None)
                if n is None:
                    content = {}
                    break
                content[n] = content.get(n, 0) + 1
            if not content:
                break
            many = min(todo, *(left[n] // c for n, c in content.items()))
            groups.append((many, content))
            for n, c in content.items():
                left[n] -= many * c
            todo -= many
    # best fit of what is left, on groups of equal containers, by free room
    free: list[tuple[int, int]] = sorted((capacity - sum(n * c for n, c in g.items()), i) for i, (_, g) in enumerate(groups))
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(free, (n, -1))
            if at < len(free):
                room, i = free.pop(at)
                many, content = groups[i]
                each = room // n
                if todo < many:
                    groups[i] = (many - todo, content)
                    insort(free, (room, i))
                    groups.append((todo, content | {n: content.get(n, 0) + 1}))
                    insort(free, (room - n, len(groups) - 1))
                    todo = 0
                else:
                    each = min(each, todo // many)
                    groups[i] = (many, content | {n: content.get(n, 0) + each})
                    insort(free, (room - n * each, i))
                    todo -= many * each
            else:
                each = min(capacity // n, todo)
                many = todo // each
                groups.append((many, {n: each}))
                insort(free, (capacity - n * each, len(groups) - 1))
                todo -= many * each
    return groups


def places(groups: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, last rank, container of the first): where the documents of each rank go."""
    out, used, base = [], {}, 0
    for many, content in groups:
        for n, each in sorted(content.items()):
            for _ in range(each):
                r = used.get(n, 0)
                out.append((n, r, r + many - 1, base))
                used[n] = r + many
        base += many
    return out


def packed(df: DataFrame, id_col: str, text: str, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """id, piece, start_token, n_tokens, container for every document or piece.

    Documents without tokens (null or empty text) get one row without container.  Ids should be unique; repeated ids
    are packed as separate documents.  The result fills each container with at most ``capacity`` tokens.
    """
    spark = df.sparkSession
    sizes = cut(token_counts(df, id_col, text, folder))
    empty = sizes.where("n = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.col("n").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    some = sizes.where("n > 0").select("id", "n", F.posexplode(F.expr(f"sequence(0L, n - 1, {capacity}L)")).alias("piece", "start_token"))
    some = some.select("id", "piece", "start_token", F.least(F.col("n") - F.col("start_token"), F.lit(capacity)).alias("n_tokens"))
    rows = some.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()  # at most ``capacity`` rows
    histogram = {r["n_tokens"]: r["c"] for r in rows}
    shards = max(8, sum(histogram.values()) // 250_000)
    some = some.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    per = some.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("shard")) - F.col("c")).drop("c")
    within = F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy("id", "piece")) - 1
    ranked = some.withColumn("within", within).join(before, ["n_tokens", "shard"]).withColumn("rank", F.col("before") + F.col("within"))
    # the plan is bounded by patterns and lengths, not by documents
    table = np.array(sorted(places(plan(histogram, capacity))) or [(0, 0, 0, 0)], dtype=np.int64)
    shipped = spark.sparkContext.broadcast(((table[:, 0] << RANK_BITS) + table[:, 1], table[:, 3] - table[:, 1]))

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        keys, shift = shipped.value
        r = rank.to_numpy()
        return pd.Series(shift[np.searchsorted(keys, (n.to_numpy() << RANK_BITS) + r, side="right") - 1] + r)

    put = ranked.select("id", "piece", "start_token", "n_tokens", container("n_tokens", "rank").alias("container"))
    return put.unionByName(empty)
