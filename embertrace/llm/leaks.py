"""Evaluation texts leaking into training text: latent semantic retrieval, longest common subsequences, answer checks.

1. Passages are windows of ``3 * BLOCK`` words, one starting every ``2 * BLOCK`` words, in documents and items alike, so that
   any ``BLOCK`` successive words lie whole in some passage on either side.  Terms are the words of the evaluation items; a
   word outside them weighs nothing.
2. One pass over all documents counts document frequencies and sketches the passage matrix: each task forms C'(C G) for
   the term counts C of its passages and one fixed random G; Spark adds these (terms x ``SKETCH``) sketches with map-side
   sums.  The driver scales them by squared IDF (at most one and a half times the median), adds the items' own passages (weighted up, so that the latent space separates
   items too) and takes the singular vectors: a randomised SVD of the TF-IDF passages of the whole corpus.
3. A second pass projects every passage into that space; the items' passages within cosine ``COSINE`` are its candidates, and
   nothing else is.
4. Each candidate gets its longest common subsequence (gaps allowed) and the share of the item passage's rarest words (its
   answer) that the document passage holds.  Candidates with ``ALIKE`` words in common order are searched for the longest run
   of successive item words, where a misspelt word still counts and inserted time or quote marks don't interrupt; every seed
   that lies in no run tried before is tried.

The item side is small by nature; it is taken in blocks of ``ITEM_WORDS`` words, which bounds what is broadcast.  Blocks of items'
passages are compared within one scan.  The work of step 3 is (document passages) x (item passages) x ``RANK``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 12
SPAN, STRIDE = 3 * BLOCK, 2 * BLOCK
RANK, SKETCH = 128, 32
COSINE = 0.35
ALIKE = 8  # words of a run's BLOCK that are spelled right
ANSWER = 5
PARAPHRASE = 0.6
ITEM_WORDS = 4_000_000
ITEM_WEIGHT = 10.0
PASSAGE_BLOCK = 4096
SUB_WORDS = 40_000
MARK = re.compile(r"^\W*(\d{1,3}:\d\d(:\d\d)?|t=\d+|slot=\d+)\W*$")
CLEAN = re.compile(r"[\W_]+")


def word(raw: str) -> str:
    """A lower-case token's letters and digits; '' for time marks, quote marks and other punctuation."""
    return "" if MARK.match(raw) else CLEAN.sub("", raw)


class Vocabulary:
    """Raw token -> id: items' words 0..n-1, any other word n, no word -1.  The memory of raw tokens is limited."""

    LIMIT = 200_000

    def __init__(self, words: list[str]):
        self.ids = {w: i for i, w in enumerate(words)}
        self.n = len(words)
        self.seen: dict[str, int] = {}
        self.spelt: dict[str, str] = {}

    def spell(self, text: str) -> list[str]:
        """The words of the text."""
        spelt, raw = self.spelt, text.lower().split()
        try:
            return [w for w in [spelt[t] for t in raw] if w]
        except KeyError:
            if len(spelt) > self.LIMIT:
                spelt.clear()
            for t in raw:
                if t not in spelt:
                    spelt[t] = word(t)
            return [w for w in [spelt[t] for t in raw] if w]

    def encode(self, text: str) -> np.ndarray:
        seen, raw = self.seen, text.lower().split()
        try:
            ids = [seen[t] for t in raw]
        except KeyError:
            if len(seen) > self.LIMIT:
                seen.clear()
            for t in raw:
                if t not in seen:
                    w = word(t)
                    seen[t] = self.ids.get(w, self.n) if w else -1
            ids = [seen[t] for t in raw]
        a = np.array(ids, dtype=np.int32)
        return a[a >= 0]


def _batches(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents in groups of about SUB_WORDS words: their places, word ids, and where each begins and the last ends."""
    places, parts, n = [], [], 0
    for place, a in texts:
        if len(a):
            places.append(place)
            parts.append(a)
            n += len(a)
        if n >= SUB_WORDS:
            yield places, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            places, parts, n = [], [], 0
    if n:
        yield places, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of BLOCK words, and the document of each."""
    sizes = np.diff(bounds)
    many = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), many)
    return bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * BLOCK, doc


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages, and the document of each."""
    many = np.maximum(-(-(np.diff(bounds) - BLOCK + 1) // STRIDE), 1)
    doc = np.repeat(np.arange(len(many)), many)
    return bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE, doc


def passage_sums(ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, documents, sums of ``weights`` rows) of the passages."""
    at, of = _blocks(bounds)
    sums = np.add.reduceat(weights[ids], at, axis=0)
    starts, doc = passages(bounds)
    first = np.searchsorted(at, starts)
    out = sums[first]
    for k in (1, 2):
        there = np.flatnonzero((first + k < len(at)) & (of[np.minimum(first + k, len(at) - 1)] == doc))
        out[there] += sums[first[there] + k]
    return starts, doc, out


def passage_words(ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray, doc: np.ndarray, none: int) -> np.ndarray:
    """The word ids of passages, ``none`` after the end of a document."""
    x = starts[:, None] + np.arange(SPAN)
    return np.where(x < bounds[1:][doc][:, None], ids[np.minimum(x, len(ids) - 1)], none)


def _gram(ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """C'(C G): what the passages' projections give back to their terms."""
    starts, doc, p = passage_sums(ids, bounds, weights)
    at, of = _blocks(bounds)
    back = np.zeros((len(at), p.shape[1]), dtype=np.float32)  # a block lies in one or two passages
    first = np.searchsorted(at, starts)
    for k in (0, 1, 2):
        there = np.flatnonzero((first + k < len(at)) & (of[np.minimum(first + k, len(at) - 1)] == doc))
        back[first[there] + k] += p[there]
    block = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))
    known = np.flatnonzero(ids < n)
    order = known[np.argsort(ids[known], kind="stable")]
    terms, begin = np.unique(ids[order], return_index=True)
    y = np.zeros((n, p.shape[1]), dtype=np.float32)
    if len(terms):
        y[terms] = np.add.reduceat(back[block[order]], begin, axis=0)
    return y


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def equal_bits(equal: np.ndarray) -> np.ndarray:
    """(candidate, document word): the item words that equal it, as bits."""
    packed = np.packbits(equal, axis=2, bitorder="little")
    wide = np.zeros((*packed.shape[:2], 8), dtype=np.uint8)
    wide[:, :, : packed.shape[2]] = packed
    return wide.view("<u8")[:, :, 0]


def common_length(bits: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each candidate's passages, by bit-parallel columns (SPAN is less than 64)."""
    v = np.full(len(bits), (1 << SPAN) - 1, dtype=np.uint64)
    for x in range(bits.shape[1]):
        u = v & bits[:, x]
        v = (v + u) | (v - u)
    return SPAN - np.bitwise_count(v & np.uint64((1 << SPAN) - 1)).astype(np.int64)


def diagonals(equal: np.ndarray) -> np.ndarray:
    """(candidate, diagonal): the document words that equal the item's along the diagonal, as bits; the item's word is
    word - diagonal + SPAN - 1."""
    wide = np.zeros((len(equal), SPAN, 2 * SPAN), dtype=np.uint8)
    wide[:, :, :SPAN] = equal[:, :, ::-1]
    lines = wide.reshape(len(equal), -1)[:, : SPAN * (2 * SPAN - 1)].reshape(len(equal), SPAN, 2 * SPAN - 1)
    out = np.zeros((len(equal), 2 * SPAN - 1), dtype=np.uint64)
    for byte in range(-(-SPAN // 8)):
        part = np.zeros((len(equal), 2 * SPAN - 1), dtype=np.uint8)
        for k, x in enumerate(range(8 * byte, min(8 * byte + 8, SPAN))):
            part |= lines[:, x] << np.uint8(k)
        out |= part.astype(np.uint64) << np.uint64(8 * byte)
    return out


def runs(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidates with BLOCK equal words in a row; (candidate, diagonal) where BLOCK successive places hold ALIKE equal words or
    more on the diagonal and its neighbours, as a word torn apart or an inserted mark moves a run by one)."""
    row, n = lines, 1
    while n < BLOCK:
        step = min(n, BLOCK - n)
        row = row & (row >> np.uint64(step))
        n += step
    whole = row.any(axis=1)
    band = lines.copy()
    band[:, 1:] |= lines[:, :-1]
    band[:, :-1] |= lines[:, 1:]
    on = np.zeros(lines.shape, dtype=bool)
    c, g = np.nonzero((np.bitwise_count(band) >= ALIKE) & ~whole[:, None])
    some = band[c, g]
    for x in range(SPAN - BLOCK + 1):
        on[c, g] |= np.bitwise_count((some >> np.uint64(x)) & np.uint64((1 << BLOCK) - 1)) >= ALIKE
    on[:, 1:] |= on[:, :-1].copy()
    on[:, :-1] |= on[:, 1:].copy()
    return whole, on


def near(a: str, b: str) -> bool:
    """Equal but for a misspelling."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if n < 4 or abs(len(a) - len(b)) > 2:
        return False
    i, m = 0, min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return n - i - j <= (1 if n < 6 else 2)


def _extend(doc: list[str], item: list[str], x: int, y: int, step: int, enough: int) -> int:
    """Item words matched in a row from (x, y) in one direction."""
    n = 0

    def at(ws: list[str], k: int) -> str:
        return ws[k] if 0 <= k < len(ws) else ""

    while n < enough and 0 <= y < len(item) and 0 <= x < len(doc):
        if near(doc[x], item[y]):
            x, y, n = x + step, y + step, n + 1
        elif at(doc, x + step) and item[y] in (doc[x] + doc[x + step], doc[x + step] + doc[x]):  # a word torn apart
            x, y, n = x + 2 * step, y + step, n + 1
        elif at(item, y + step) and doc[x] in (item[y] + item[y + step], item[y + step] + item[y]):  # two words run together
            x, y, n = x + step, y + 2 * step, n + 2
        elif not doc[x].isalpha() and all(at(doc, x + k * step) == at(item, y + (k - 1) * step) != "" for k in (1, 2)):  # an inserted mark
            x += step
        else:
            break
    return n


def run_length(doc: list[str], item: list[str], i: int, j: int, enough: int = BLOCK) -> int:
    """Successive item words in ``doc`` around the match of doc[i] and item[j] (it may stop at ``enough``)."""
    n = _extend(doc, item, i, j, 1, enough)
    return n + _extend(doc, item, i - 1, j - 1, -1, enough - n) if n < enough else n


def longest_run(doc: list[str], item: list[str], seeds: list[tuple[int, int]], enough: int, tried: set[tuple[int, int]]) -> int:
    """The longest run around any of the seeds, or the first of ``enough`` words.  A seed is passed over only if it was tried before,
    or lies on the same diagonal within a run of equal words that was."""
    best = 0
    for x, y in seeds:
        if (x, y) in tried:
            continue
        a, b = x, y
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        while a < len(doc) and b < len(item) and doc[a] == item[b]:
            tried.add((a, b))
            a, b = a + 1, b + 1
        best = max(best, run_length(doc, item, x, y, enough))
        if best >= enough:
            break
    return best


def _block_leaks(docs: DataFrame, items: list[tuple[int, str]], least: int) -> DataFrame:
    """doc_id, item_id, cosine, common, answer, run for the candidates that have enough words in common order."""
    sc = docs.sparkSession.sparkContext
    spelled = [[w for w in map(word, t.lower().split()) if w] for _, t in items]
    item_ids = [i for i, _ in items]
    words = sorted({w for ws in spelled for w in ws})
    vocabulary = Vocabulary(words)
    n = len(words)
    own = [vocabulary.encode(" ".join(ws)) for ws in spelled]
    own_ids, own_bounds = np.concatenate(own), np.cumsum([0, *map(len, own)])
    prior = np.zeros(n + 1)
    for ids in own:
        prior[np.unique(ids)] += 1
    prior = np.log((len(items) + 1) / np.maximum(prior, 1)) + 0.1  # only shapes the random directions
    rng = np.random.default_rng(20)
    probe = (rng.standard_normal((n + 1, RANK)) * prior[:, None]).astype(np.float32)
    probe[n] = 0
    given = sc.broadcast((vocabulary, probe[:, :SKETCH].copy()))
    columns = [f"y{k}" for k in range(SKETCH)]

    def sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, probe = given.value
        y, df, rows = np.zeros((n + 1, SKETCH)), np.zeros(n + 1, dtype=np.int64), 0
        for f in frames:
            for _, ids, bounds in _batches((k, vocabulary.encode(t)) for k, t in enumerate(f["text"])):
                y[:n] += _gram(ids, bounds, probe, n)
                of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
                df += np.bincount(np.unique(of * (n + 1) + ids) % (n + 1), minlength=n + 1)
            rows += len(f)
        df[n] = rows  # the last term counts the documents
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": some, "df": df[some]} | {c: y[some, k] for k, c in enumerate(columns)})

    parts = docs.select("text").mapInPandas(sketches, "term int, df long, " + ", ".join(f"{c} double" for c in columns))
    y, df = np.zeros((n + 1, SKETCH)), np.zeros(n + 1)
    got = parts.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(c).alias(c) for c in columns]).toPandas()  # at most the items' words
    y[got["term"].to_numpy()], df[got["term"].to_numpy()] = got[columns].to_numpy(), got["df"].to_numpy()
    idf = np.append(np.where(df[:n] > 0, np.log((df[n] + 1) / (df[:n] + 1)) + 0.1, 0.0), 0.0)  # a word of no document tells nothing
    usual = float(np.median(idf[idf > 0])) if (idf > 0).any() else 1.0
    weight = (np.minimum(idf, 1.5 * usual) ** 2)[:, None]  # no single rare word decides
    corpus = y[:n] * weight[:n] @ rng.standard_normal((SKETCH, RANK))
    mine = _gram(own_ids, own_bounds, probe, n) * weight[:n]
    scale = ITEM_WEIGHT * max(np.abs(corpus).sum(), 1.0) / max(np.abs(mine).sum(), 1e-9)
    u, s, _ = np.linalg.svd(corpus + scale * mine, full_matrices=False)
    basis = np.zeros((n + 1, RANK), dtype=np.float32)
    basis[:n, : u.shape[1]] = u * (s > 1e-9 * max(s[0], 1e-300)) * weight[:n]
    starts, passage_item, centres = passage_sums(own_ids, own_bounds, basis)
    written = passage_words(own_ids, own_bounds, starts, passage_item, -2)
    rare = np.argsort(-np.where(written >= 0, idf[written], -1.0), axis=1, kind="stable")[:, :ANSWER]
    answers = np.zeros(len(written), dtype=np.uint64)
    for k in range(ANSWER):
        place = rare[:, k]
        answers |= np.where(written[np.arange(len(written)), place] >= 0, np.uint64(1) << place.astype(np.uint64), np.uint64(0))
    size = (written >= 0).sum(axis=1)
    model = sc.broadcast((vocabulary, spelled, basis, _unit(centres), passage_item, starts - own_bounds[:-1][passage_item], written, answers, size))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, spelled, basis, centres, of_item, item_at, written, answers, size = model.value
        for f in frames:
            texts, names, out = f["text"].tolist(), f["doc_id"].tolist(), []
            for places, ids, bounds in _batches((k, vocabulary.encode(t)) for k, t in enumerate(texts)):
                starts, doc, sums = passage_sums(ids, bounds, basis)
                sums = _unit(sums)
                best: dict[tuple[int, int], list] = {}
                tried: dict[tuple[int, int], set] = {}
                spelling: dict[int, list[str]] = {}
                for lo in range(0, len(centres), PASSAGE_BLOCK):
                    cosine = sums @ centres[lo : lo + PASSAGE_BLOCK].T
                    every = np.flatnonzero(cosine.ravel() >= COSINE)
                    for part in range(0, len(every), 20_000):
                        w, p = np.divmod(every[part : part + 20_000], cosine.shape[1])
                        here = cosine[w, p]
                        p = p + lo
                        mine = passage_words(ids, bounds, starts[w], doc[w], n)
                        equal = mine[:, :, None] == written[p][:, None, :]
                        bits = equal_bits(equal)
                        common = common_length(bits)
                        kept = np.flatnonzero(common >= np.minimum(ALIKE, size[p]))
                        if not len(kept):
                            continue
                        w, p, here, common, equal = w[kept], p[kept], here[kept], common[kept], equal[kept]
                        held = np.bitwise_or.reduce(bits[kept], axis=1) & answers[p]
                        answer = np.bitwise_count(held) / np.maximum(np.bitwise_count(answers[p]), 1)
                        lines = diagonals(equal)
                        whole, on = runs(lines)
                        some = on.any(axis=1)
                        share = common / np.maximum(size[p], 1)
                        for c in np.flatnonzero(whole | some | ((share >= PARAPHRASE) & (answer >= PARAPHRASE))).tolist():
                            d, k = int(doc[w[c]]), int(of_item[p[c]])
                            b = best.setdefault((d, k), [0.0, 0.0, 0.0, 0])
                            if (share[c], answer[c]) > (b[1], b[2]):
                                b[:3] = float(here[c]), float(share[c]), float(answer[c])
                            if whole[c] and least <= BLOCK:
                                b[3] = BLOCK
                            if b[3] >= least or not (some[c] or whole[c]):
                                continue
                            if d not in spelling:
                                spelling[d] = vocabulary.spell(texts[places[d]])
                            line, x = np.nonzero((lines[c, :, None] >> np.arange(SPAN, dtype=np.uint64)) & np.uint64(1) & (on[c] | whole[c])[:, None])
                            x0, y0 = int(starts[w[c]] - bounds[d]), int(item_at[p[c]])
                            seeds = [(x0 + i, y0 + i - g + SPAN - 1) for i, g in zip(x.tolist(), line.tolist(), strict=True)]
                            b[3] = max(b[3], longest_run(spelling[d], spelled[k], seeds, least, tried.setdefault((d, k), set())))
                out += [(names[places[d]], item_ids[k], *b) for (d, k), b in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "common", "answer", "run"]).astype({"doc_id": "int64", "item_id": "int64", "run": "int32"})

    return docs.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, cosine double, common double, answer double, run int")


def leak_candidates(docs: DataFrame, items: DataFrame, least: int = BLOCK) -> DataFrame:
    """doc_id, item_id, cosine, common, answer, run: documents and items with a verbatim run or a paraphrased passage.

    run: the longest run of successive item words that was found (it may stop at ``least``); common and answer: the shares of an
    item passage's words in common order, and of its rarest words, in the best document passage.
    Null and empty texts on either side never match; an item shorter than ``least`` words can't leak; repeated
    documents each get their rows.  Empty tables give an empty result.
    """
    d = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    out = None
    kept = items.select("item_id", "text").where("text IS NOT NULL").withColumn("n", F.size(F.split("text", r"\s+")))
    words = kept.agg(F.sum("n")).first()[0] or 0
    blocks = -(-words // ITEM_WORDS)
    for b in range(blocks):
        part = kept.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id").collect() if len([w for w in map(word, r["text"].lower().split()) if w]) >= least]
        if rows:
            found = _block_leaks(d, rows, least)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answer double, run int")


def leaked_items(docs: DataFrame, items: DataFrame, least: int = BLOCK) -> DataFrame:
    """doc_id, item_id: documents (doc_id, text) with ``least`` or more successive words of an item (item_id, text)."""
    return leak_candidates(docs, items, least).where(F.col("run") >= least).select("doc_id", "item_id")
