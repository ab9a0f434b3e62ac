"""Garbled text from wrong character encoding: expectation-maximisation over latent encoding chains.

A chain (wrong, right, times) says: the bytes of ``right`` text were read as ``wrong``, so ``encode(wrong)`` then
``decode(right)`` restores it.  Hypotheses for a token are identity and every chain that yields a clean
string.  The latent chain of a token is scored by a character bigram model of clean text and by the chain's prior in the
token's pool (source and field); both are estimated together by EM over the counts of all tokens with rare characters, so
weak evidence in one record is backed by all others of its pool, and garbled bigrams lose their weight as
their tokens are explained by chains.  Each record is then judged and repaired by its own posterior: chains with enough
evidence in the record become likely for its other tokens too.  Replacement characters mark a loss that no chain can undo.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.session import cut

UTF = "utf-8"
CHAINS = [
    ("cp1252", UTF, 1), ("latin-1", UTF, 1), ("cp1251", UTF, 1), ("cp437", UTF, 1), ("cp850", UTF, 1), ("mac_roman", UTF, 1),
    ("koi8-r", UTF, 1), ("cp866", UTF, 1), ("cp1250", UTF, 1), ("cp1252", UTF, 2), ("latin-1", UTF, 2), ("cp1251", UTF, 2),
    ("cp1252", "cp1251", 1), ("cp1252", "koi8-r", 1), ("cp1251", "koi8-r", 1), ("koi8-r", "cp1251", 1), ("cp866", "cp1251", 1),
    ("cp1251", "cp866", 1), ("cp1252", "cp866", 1), ("cp437", "cp1252", 1), ("cp850", "cp1252", 1), ("mac_roman", "cp1252", 1),
    ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac_roman", 1), ("cp1251", "cp1252", 1),
]
LOST = "lost"
NAMES = [f"{w}>{r}" + (f"x{n}" if n > 1 else "") for w, r, n in CHAINS]
BINS = 1 << 18
ROUNDS = 4
MOST_POOLS = 20_000  # priors of so many pools (a row of 27 numbers each) are broadcast, more are joined
ENOUGH = 5.0
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
#: A no-break space after an ASCII character is a blank; after others it may be the second byte of a garbled letter.
NBSP = re.compile(r"(?<=[\x00-\x7f])\xa0")
BLANK = re.compile(r"([ \n\t\r]|(?<=[\x00-\x7f])\xa0)")
TORN_CASE = re.compile(r"[a-zà-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]")


def _sloppy(name: str) -> tuple[dict[str, int], list[str]]:
    """A single-byte table in which undefined bytes stand for the control of the same number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


TABLES = {n: _sloppy(n) for n in {x for w, r, _ in CHAINS for x in (w, r)} - {UTF}}
WRONG = list(dict.fromkeys(w for w, _, _ in CHAINS))


def _encoded(token: str, wrong: str) -> bytes | None:
    back = TABLES[wrong][0]
    try:
        return bytes([back[c] for c in token])
    except KeyError:
        return None


def _decoded(raw: bytes, right: str) -> str | None:
    if right != UTF:
        chars = TABLES[right][1]
        return "".join([chars[b] for b in raw])
    try:
        return raw.decode(UTF)
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data" or e.start == 0:
            return None
        token = raw[: e.start].decode(UTF)  # a cut last character
        return None if token.isascii() else token


def undo(token: str, wrong: str, right: str, times: int = 1) -> str | None:
    """The token as it was before the chain, or None if the chain can't have made it."""
    for _ in range(times):
        raw = _encoded(token, wrong)
        token = None if raw is None else _decoded(raw, right)
        if token is None:
            return None
    return token


def _clean(s: str) -> bool:
    return "�" not in s and (s.isprintable() or all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in s))


def candidates(token: str) -> list[tuple[int, str]]:
    """(chain, original) of all chains that can have made the token; its bytes are taken once for chains that share a table."""
    out, raws, once = [], {w: _encoded(token, w) for w in WRONG}, {}
    for k, (wrong, right, times) in enumerate(CHAINS):
        raw = raws[wrong]
        if raw is None:
            continue
        if (wrong, right) not in once:
            once[wrong, right] = _decoded(raw, right)
        c = once[wrong, right]
        if c is not None and times > 1:
            c = undo(c, wrong, right, times - 1)
        if c and c != token and _clean(c):
            out.append((k, c))
    return out


def _bigrams(s: str) -> tuple[list[int], list[int]]:
    o = [2, *map(ord, s.lower()), 3]
    return [(a * 7919 + b) % BINS for a, b in zip(o, o[1:], strict=False)], o[:-1]


class Model:
    """Bigram weights (bins) and weights of first characters (bins)."""

    def __init__(self, two: np.ndarray, one: np.ndarray):
        self.two, self.one = two, one
        self.log_two, self.log_one = memoryview(np.log(two + 0.02)), memoryview(np.log(one + 8.0))
        self.known: dict[str, tuple[float, list[tuple[int, str, float]]]] = {}

    def __reduce__(self) -> tuple:
        return Model, (self.two, self.one)

    @staticmethod
    def first() -> np.ndarray:
        p = np.full(len(CHAINS) + 1, 0.1 / len(CHAINS))
        p[-1] = 0.9
        return p

    def score(self, s: str) -> float:
        two, one = self.log_two, self.log_one  # tokens are short: plain lookups take less time than arrays
        b, a = _bigrams(s)
        return sum([two[x] for x in b]) - sum([one[x % BINS] for x in a]) - 4.0 * len(TORN_CASE.findall(s))

    def options(self, token: str) -> tuple[float, list[tuple[int, str, float]]]:
        """Identity's score, and (chain, original, score)."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = candidates(token)
            scores = {c: self.score(c) for c in {c for _, c in found}}  # many chains give the same original
            got = self.known[token] = self.score(token), [(k, c, scores[c]) for k, c in found]
        return got

    def posterior(self, token: str, prior: np.ndarray) -> tuple[float, list[tuple[int, str, float]]]:
        """Identity's posterior, and (chain, original, posterior)."""
        own, opts = self.options(token)
        if not opts:
            return 1.0, []
        x = np.array([own + math.log(prior[-1])] + [s + math.log(prior[k]) for k, _, s in opts])
        x = np.exp(x - x.max())
        x /= x.sum()
        return float(x[0]), [(k, c, float(p)) for (k, c, _), p in zip(opts, x[1:], strict=True)]


def rare_tokens(text: str) -> list[str]:
    if "\xa0" in text:
        text = NBSP.sub(" ", text)
    for blank in "\n\t\r":
        text = text.replace(blank, " ")
    return [t for t in text.split(" ") if not t.isascii()]


def _with_prior(rows: DataFrame, prior: DataFrame | None) -> DataFrame:
    """``rows`` plus the chain prior ``p`` of their pool; it is broadcast only if the pools are few."""
    start = F.array(*[F.lit(float(x)) for x in Model.first()])
    if prior is None:
        return rows.withColumn("p", start)
    small = prior.limit(MOST_POOLS + 1).count() <= MOST_POOLS
    return rows.join(F.broadcast(prior) if small else prior, "pool", "left").withColumn("p", F.coalesce("p", start))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, priors: pool, p): EM over (token, pool) counts of all documents (text, pool).

    The model has fixed bins whatever the data; priors stay a table, however many pools there are.
    """
    sc = docs.sparkSession.sparkContext

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for f in frames:
            for t, s in zip(f["text"], f["pool"], strict=True):
                seen.update((s, x) for x in rare_tokens(t))
            if len(seen) > 200_000:
                yield pd.DataFrame([(s, x, n) for (s, x), n in seen.items()], columns=["pool", "token", "n"])
                seen.clear()
        yield pd.DataFrame([(s, x, n) for (s, x), n in seen.items()], columns=["pool", "token", "n"])

    pairs = cut(docs.mapInPandas(count, "pool string, token string, n long").groupBy("token", "pool").agg(F.sum("n").alias("n")))
    types = pairs.groupBy("token").agg(F.sum("n").alias("total"))

    def options(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, k, c) for t in f["token"] if len(t.strip(PUNCTUATION)) > 1 for k, c in candidates(t)]
            yield pd.DataFrame(rows, columns=["token", "k", "original"])

    # where a restored form is itself written far more often, the first round takes the token for its garbled form
    made = types.select("token").mapInPandas(options, "token string, k int, original string")
    met = made.join(types.select(F.col("token").alias("original"), F.col("total").alias("m")), "original")
    likely = met.groupBy("token").agg(F.max(F.struct("m", "original")).alias("x"))
    told = types.join(likely, "token").where(F.col("x.m") > 3 * F.col("total")).select("token", F.col("x.original").alias("likely"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)
    rows = cut(pairs.join(told, "token", "left").select("token", "pool", "n", "likely").repartition(parts, "token"))  # a token's pools lie together
    model, prior = None, None
    for _ in range(ROUNDS):
        given = sc.broadcast(model)

        def step(frames: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            model = given.value
            two, one, chains, written = np.zeros(BINS), np.zeros(BINS), {}, {}

            def spell() -> None:
                for s, w in written.items():
                    b, a = _bigrams(s)
                    np.add.at(two, b, w)
                    np.add.at(one, np.array(a) % BINS, w)
                written.clear()

            def pools() -> pd.DataFrame:
                return pd.DataFrame([("chain", s, k, w) for s, c in chains.items() for k, w in enumerate(c.tolist()) if w], columns=["kind", "pool", "key", "w"])

            for f in frames:
                for token, pool, n, likely, prior in f[["token", "pool", "n", "likely", "p"]].itertuples(index=False):
                    opts = model.options(token)[1] if model else []
                    if not model and likely:
                        token = likely
                    weights = {token: float(n)}
                    if model:
                        c = chains.setdefault(pool, np.zeros(len(CHAINS) + 1))
                        own, rest = model.posterior(token, prior) if opts else (1.0, [])
                        c[-1] += own * n
                        weights = {token: own * n}
                        for k, o, p in rest:
                            c[k] += p * n
                            weights[o] = weights.get(o, 0.0) + p * n
                    for s, w in weights.items():
                        if w > 1e-6:
                            written[s] = written.get(s, 0.0) + w
                if len(written) > 100_000:
                    spell()
                if len(chains) > 2000:
                    yield pools()
                    chains.clear()
            spell()
            for kind, v in (("two", two), ("one", one)):
                some = np.flatnonzero(v)
                yield pd.DataFrame({"kind": kind, "pool": "", "key": some, "w": v[some]})
            yield pools()

        got = cut(_with_prior(rows, prior).mapInPandas(step, "kind string, pool string, key int, w double").groupBy("kind", "pool", "key").agg(F.sum("w").alias("w")))
        two, one = np.zeros(BINS), np.zeros(BINS)
        bins = got.where("kind <> 'chain'").select("kind", "key", "w").toPandas()  # fixed bins
        for kind, v in (("two", two), ("one", one)):
            part = bins[bins["kind"] == kind]
            v[part["key"].to_numpy()] = part["w"]
        if model is not None:
            by_chain = F.map_from_entries(F.collect_list(F.struct("key", "w")))  # an entry a chain
            start = F.array(*[F.lit(20.0 * float(x)) for x in Model.first()])
            c = got.where("kind = 'chain'").groupBy("pool").agg(by_chain.alias("m"), F.sum("w").alias("all"))
            prior = cut(c.select("pool", F.transform(start, lambda x, i: (x + F.coalesce(F.try_element_at("m", i), F.lit(0.0))) / (F.col("all") + 20.0)).alias("p")))
        model = Model(two, one)
    return model, prior


def leads(token: str, prior: np.ndarray, model: Model) -> tuple[float, tuple[int, ...]]:
    """(log odds of the best chain against identity, the chains that give that best original); 0 without evidence."""
    own, opts = model.options(token)
    if not opts or len(token.strip(PUNCTUATION)) <= 1:  # a lone sign says nothing of its own
        return 0.0, ()
    scores = [s + math.log(prior[k]) for k, _, s in opts]
    best = max(scores)
    lead = best - own - math.log(prior[-1])
    return (lead, tuple(k for (k, _, _), s in zip(opts, scores, strict=True) if s >= best - 1e-9)) if lead > 0 else (0.0, ())


def judge(text: str, prior: np.ndarray, model: Model, memory: dict) -> tuple[list[str], str, float] | None:
    """(chains, repaired text, evidence), or None for a sound record.

    memory: leads by token, and originals by (active chains, token), of one pool and its prior.
    """
    tokens = set(rare_tokens(text))
    evidence = None
    for t in tokens:
        got = memory.get(t)
        if got is None:
            if len(memory) > 100_000:
                memory.clear()
            got = memory[t] = leads(t, prior, model)
        if got[1]:
            if evidence is None:
                evidence = np.zeros(len(CHAINS))
            evidence[list(got[1])] += got[0]
    lost = "�" in text
    if evidence is None and not lost:
        return None
    evidence = np.zeros(len(CHAINS)) if evidence is None else evidence
    active = np.flatnonzero(evidence >= ENOUGH)
    if not len(active) and not lost:
        return None
    chains = [NAMES[k] for k in active] + ([LOST] if lost else [])
    if not len(active):
        return chains, text, float("inf")
    local = prior.copy()
    local[active] = np.maximum(local[active], 0.5 / len(active))
    local /= local.sum()
    fixed: dict[str, str] = {}
    key = active.tobytes()
    for t in tokens:
        original = memory.get((key, t))
        if original is None:
            if len(memory) > 100_000:
                memory.clear()
            own, opts = model.posterior(t, local)
            best = max(opts, key=lambda x: x[2], default=None)
            original = memory[key, t] = best[1] if best and best[2] > own else t
        fixed[t] = original
    parts = BLANK.split(text)  # words, and blanks between them
    parts[::2] = [fixed.get(w, w) for w in parts[::2]]
    return chains, "".join(parts), float(evidence.max())


def garbled(docs: DataFrame, id_col: str, text: str | Sequence[str], source: str) -> DataFrame:
    """id, field, chains, evidence, repaired: the records with wrongly decoded text; other records give no row.

    text: one or more columns (fields).  Evidence is pooled per source and field.
    Null and empty texts are sound; a null source is a source of its own; texts of any length are judged whole; unaffected
    parts of a record stay as they are, and so do replacement characters.  Repeated records are judged alike.
    """
    fields = [text] if isinstance(text, str) else list(text)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), name.alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fields])).alias("x"))
    d = d.select("id", F.col("x.field").alias("field"), F.col("x.text").alias("text"), F.concat("x.field", F.lit("\t"), "source").alias("pool"))
    d = d.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    model, prior = fit(d.select("text", "pool"))
    model.known = {}
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        memories: dict[str, dict] = {}
        for f in frames:
            if len(memories) > 64:
                memories.clear()
            rows = []
            for i, field, t, s, p in f[["id", "field", "text", "pool", "p"]].itertuples(index=False):
                r = judge(t, np.asarray(p), model, memories.setdefault(s, {}))
                if r:
                    rows.append((i, field, ",".join(r[0]), r[2], r[1]))
            yield pd.DataFrame(rows, columns=["id", "field", "chains", "evidence", "repaired"])

    return _with_prior(d, prior).mapInPandas(repair, f"id {kind}, field string, chains string, evidence double, repaired string")
