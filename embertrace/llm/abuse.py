"""Abusive, hateful or sexual content: class-conditional Kneser-Ney character models.

Two interpolated Kneser-Ney models, of abusive and of ordinary rows, share their lowest orders, so an expression that
neither class has seen says nothing.  The models are taught by a bounded sample of labelled rows; the ordinary one also by
the n-gram counts of all unlabelled texts that aren't found abusive, gathered by a distributed aggregation.  A row's score is the best length-normalised log-likelihood ratio of any stretch
of its words: a short insult inside a long message counts as much as one alone.  Abusive training rows hold ordinary
words too; after a first fit, only their best stretches train the abusive class.  Labels that contradict each other are settled before
(``consistent_label``); the models' scores never overrule a label.

Texts are first brought to one form: look-alikes resolved, case and accents of no weight, spaced or dotted letters
joined, digits and signs inside words read as letters, stretched letters shortened.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.lookalike import build_table, consistent_form
from embertrace.session import cut

ORDER = 6
SHARED = 2  # orders up to this are pooled
DISCOUNT = 0.75
NOISE = 0.02  # share of a class's counts that errors of annotation may put into the other
LEAN = 3.0  # ordinary counts that weigh on a context of the abusive class
EVERY = 12  # stretches of so many words are all tried, longer ones by growing lengths
SHORTEST = 4.0  # characters added to a stretch's length before normalising
SAMPLE_ROWS = 8_000
BIN_BITS = 24  # n-grams are counted in so many hash bins an order, so a model's size has a bound
#: Signs that stand for letters inside a word (fixed values).
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
LETTERS = r"[^\W\d_]"
DOTTED = re.compile(rf"(?<!\w)(?:{LETTERS}[.\-_*]){{2,}}{LETTERS}(?!\w)")
SPACED = re.compile(rf"(?<!\S)(?:{LETTERS} ){{2,}}{LETTERS}(?!\S)")
STRETCHED = re.compile(r"(.)\1{2,}")
MIXED = re.compile(r"\S*[^\W\d_]\S*")
OTHER = re.compile(r"[^\w*]+")
NUMBER = re.compile(r"\d+")


def plain_form(text: str, looks: dict) -> str:
    t = unicodedata.normalize("NFKC", consistent_form(text, looks)[0] or "").lower()
    t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    t = DOTTED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), t)
    t = SPACED.sub(lambda m: m[0].replace(" ", ""), t)

    def letters(m: re.Match) -> str:
        w = m[0]
        core = w.rstrip("!|.,?:;")
        digits = sum(c.isdigit() for c in core)
        if digits and (core[-1].isdigit() and core[: -digits].isalpha()):  # a name with a number
            return core[:-digits] + w[len(core):]
        return core.translate(SIGNS) + w[len(core):]

    t = MIXED.sub(letters, t)
    t = STRETCHED.sub(r"\1", t)
    t = NUMBER.sub("0", OTHER.sub(" ", t)).strip()
    return f" ^ {t} $ " if t else ""  # its ends are words too: an insult alone isn't one inside a report


def _hashes(codes: np.ndarray, ok: np.ndarray, n: int) -> np.ndarray:
    """Hash bin of the n characters up to each place; -1 where they cross the start of a text (``ok``: place in text)."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for j in range(n - 1, -1, -1):
        part = np.zeros(len(codes), dtype=np.uint64)
        part[j:] = codes[: max(0, len(codes) - j)]
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    h[ok < n - 1] = -1
    return h


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


class Table:
    """Sorted keys with a row of numbers each; a key that is not there has zeros."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1] if self.values.ndim == 2 else 1), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], 0)


#: By order: n-grams, their suffixes and contexts (both of the order below), counts and starts of a text by class.
Levels = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
CLASSES = 3  # ordinary by label, abusive, ordinary without a label


def gram_levels(texts: list[str], classes: list[int]) -> Levels:
    """The n-grams of the texts."""
    codes, place, _ = _codes(texts)
    of = np.repeat(np.array(classes, dtype=np.int64), [len(t) for t in texts])
    out, below = {}, np.zeros(len(codes), dtype=np.int64)
    for n in range(1, ORDER + 1):
        h = _hashes(codes, place, n)
        context = np.zeros(len(codes), dtype=np.int64)
        if n > 1:
            context[1:] = below[:-1]
        known = h >= 0
        key, at, inv = np.unique(h[known], return_index=True, return_inverse=True)
        y, start = of[known], place[known] == n - 1
        counts = np.stack([np.bincount(inv, weights=y == k, minlength=len(key)) for k in range(CLASSES)], axis=1)
        starts = np.stack([np.bincount(inv, weights=start & (y == k), minlength=len(key)) for k in range(CLASSES)], axis=1)
        out[n] = key, below[known][at], context[known][at], counts, starts
        below = h
    return out


def joined(a: Levels, b: Levels) -> Levels:
    """The sums of two tables of n-grams."""
    out = {}
    for n in range(1, ORDER + 1):
        key, at, inv = np.unique(np.concatenate([a[n][0], b[n][0]]), return_index=True, return_inverse=True)
        suffix, context = (np.concatenate([a[n][k], b[n][k]])[at] for k in (1, 2))
        sums = []
        for k in (3, 4):
            total = np.zeros((len(key), CLASSES))
            total[inv[: len(a[n][0])]] += a[n][k]
            total[inv[len(a[n][0]) :]] += b[n][k]
            sums.append(total)
        out[n] = key, suffix, context, *sums
    return out


class Contrast:
    """Two Kneser-Ney models over characters; column 0 is ordinary, 1 abusive."""

    def __init__(self, texts: list[str], labels: list[int], noise: float = 0.0, unlabelled: Levels | None = None):
        levels = gram_levels(texts, labels)
        if unlabelled is not None:
            levels = joined(unlabelled, levels)
        self.grams, self.contexts = {}, {}
        for n in range(1, ORDER + 1):
            key, _, first, counts, starts = levels[n]

            def of(classes: tuple[int, ...], n=n, key=key, counts=counts, starts=starts) -> np.ndarray:
                if n == ORDER:  # raw counts; below, the number of different characters to the left
                    return counts[:, classes].sum(axis=1)
                _, suffix, _, longer, _ = levels[n + 1]
                there = suffix[longer[:, classes].sum(axis=1) > 0]
                left = np.bincount(np.searchsorted(key, there), minlength=len(key))
                return left + (starts[:, classes].sum(axis=1) > 0)

            annotated = np.stack([of((0,)), of((1,))], axis=1).astype(np.float64)
            counts = np.stack([of((0, 2)), annotated[:, 1]], axis=1) if unlabelled is not None else annotated
            if noise and n > SHARED:  # what mislabelled rows of the other class would have left here
                other = annotated[:, ::-1]
                counts = np.maximum(counts - noise * other - ((counts == 1) & (other > 2)), 0)
            if n <= SHARED:
                counts = np.repeat(counts.sum(axis=1, keepdims=True), 2, axis=1)
            self.grams[n] = Table(key, counts)
            ckey, cinv = np.unique(first, return_inverse=True)
            stats = np.stack([np.bincount(cinv, weights=counts[:, k], minlength=len(ckey)) for k in (0, 1)]
                             + [np.bincount(cinv, weights=counts[:, k] > 0, minlength=len(ckey)) for k in (0, 1)], axis=1)
            self.contexts[n] = Table(ckey, stats)

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood ratio of each character of all texts, and the texts' starts."""
        codes, place, starts = _codes(texts)
        p = np.full((len(codes), 2), 1e-4, dtype=np.float64)
        before = np.zeros(len(codes), dtype=np.int64)
        for n in range(1, ORDER + 1):
            h = _hashes(codes, place, n)
            known = h >= 0
            count = self.grams[n][h[known]]
            stats = self.contexts[n][before[known]]
            total = np.maximum(stats[:, :2], 1e-9)
            count = np.minimum(count, stats[:, :2])  # n-grams of one bin may have several contexts
            q = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * stats[:, 2:] / total * p[known]
            p[known] = np.where(stats[:, :2] > 0, q, p[known])
            if n > SHARED:  # the abusive class leans on ordinary counts until it has its own
                own = stats[:, 1]
                p[known, 1] = np.where(own > 0, (own * p[known, 1] + LEAN * p[known, 0]) / (own + LEAN), p[known, 1])
            before = np.full(len(codes), -1, dtype=np.int64)
            before[1:] = h[:-1]
        return np.log(p[:, 1]) - np.log(p[:, 0]), starts

    def best_stretches(self, texts: list[str]) -> list[tuple[float, int, int]]:
        """Per text: (score, first, last) of its most abusive stretch of whole words; -9 for an empty text."""
        best, lo, hi = self.stretches(texts)
        return list(zip(best.tolist(), lo.tolist(), hi.tolist(), strict=True))

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``best_stretches``, in arrays.  Stretches of up to ``EVERY`` words are all tried, longer ones by lengths that grow by a
        quarter up to the whole text: the work is in proportion to the text, and its length has no limit."""
        best, first, last = np.full(len(texts), -9.0), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        if not any(texts):
            return best, first, last
        r, starts = self.ratios(texts)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gaps = np.flatnonzero(codes == 32)
        of = np.searchsorted(starts, gaps, side="right") - 1
        m = np.concatenate([[0.0], np.cumsum(r)])[gaps + 1]
        top, reach = np.full(len(gaps), -np.inf), np.zeros(len(gaps), dtype=np.int64)
        longest = int(np.bincount(of).max()) - 1
        n = 1
        while n <= longest:
            score = np.where(of[n:] == of[:-n], (m[n:] - m[:-n]) / np.sqrt(gaps[n:] - gaps[:-n] + SHORTEST), -np.inf)
            better = np.flatnonzero(score > top[:-n])
            top[better], reach[better] = score[better], n
            n = n + 1 if n < EVERY else min(n * 5 // 4, longest) if n < longest else n + 1
        order = np.lexsort((np.arange(len(gaps)), -top, of))
        head = order[np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))]
        t = of[head]
        best[t], first[t], last[t] = top[head], gaps[head] - starts[t], gaps[head + reach[head]] - starts[t] + 1
        return best, first, last


def fit(texts: list[str], labels: list[int], unlabelled: Levels | None = None) -> Contrast:
    """Fit, then fit again with the best stretches of the abusive rows only."""
    c = Contrast(texts, labels, unlabelled=unlabelled)
    for _ in range(2):
        marked = [t for t, y in zip(texts, labels, strict=True) if y]
        plain = [t for t, y in zip(texts, labels, strict=True) if not y]
        parts = []
        for t, (score, lo, hi) in zip(marked, c.best_stretches(marked), strict=True):
            if score > 0.5:
                parts.append(t[lo:hi])
        c = Contrast(plain + parts, [0] * len(plain) + [1] * len(parts), NOISE, unlabelled)
    return c


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(threshold, F1) with the greatest F1; the middle of the gap above the last score that is left out."""
    order = np.argsort(-scores)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(scores) + 1) + max(labels.sum(), 1))
    k = int(f1.argmax())
    s = scores[order]
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2), float(f1[k])


def held_out(texts: list[str], taught: np.ndarray, folds: int = 3, unlabelled: Levels | None = None) -> np.ndarray:
    """Scores of all texts by models that haven't seen them, taught with the labels ``taught`` and the n-grams ``unlabelled``."""
    groups = {t: k for k, t in enumerate(sorted(set(texts)))}
    fold = np.array([groups[t] * 7919 % folds for t in texts])
    scores = np.zeros(len(texts))
    for k in range(folds):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        c = fit([texts[i] for i in train], taught[train].tolist(), unlabelled)
        scores[test] = [s for s, _, _ in c.best_stretches([texts[i] for i in test])]
    return scores


def cross_fit(texts: list[str], labels: list[int], ordinary: Callable[[Contrast, float, set[str]], Levels] | None = None) -> tuple[Contrast, float, float]:
    """(model, threshold, held-out F1).

    The threshold comes from rows that the scoring model hasn't seen.  Unlabelled texts teach the ordinary class too, as far as a model takes
    them for ordinary: ``ordinary`` gives the n-grams of those that it scores below a threshold, without the texts of a set.
    """
    y = np.array(labels)
    scores = held_out(texts, y)
    threshold, f1 = best_threshold(scores, y)
    seen, unlabelled = set(texts), None
    for _ in range(2 if ordinary else 0):
        unlabelled = ordinary(fit(texts, labels, unlabelled), threshold, seen)
        scores = held_out(texts, y, unlabelled=unlabelled)
        threshold, f1 = best_threshold(scores, y)
    return fit(texts, labels, unlabelled), threshold, f1


def ordinary_levels(forms: DataFrame, model: Contrast, threshold: float, seen: set[str]) -> Levels:
    """The n-grams of all texts (form) that the model scores below the threshold, without those of ``seen``."""
    given = forms.sparkSession.sparkContext.broadcast(model)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 2000):
                texts = [t for t in f["form"].iloc[lo : lo + 2000] if t not in seen]
                low = [t for t, s in zip(texts, given.value.stretches(texts)[0], strict=True) if s < threshold]
                for n, (key, suffix, context, counts, starts) in gram_levels(low, [2] * len(low)).items():
                    yield pd.DataFrame({"n": n, "key": key, "suffix": suffix, "context": context, "many": counts[:, 2], "starts": starts[:, 2]})

    parts = forms.mapInPandas(grams, "n int, key int, suffix int, context int, many double, starts double")
    got = parts.groupBy("n", "key").agg(*[F.min(c).alias(c) for c in ("suffix", "context")], *[F.sum(c).alias(c) for c in ("many", "starts")]).toPandas()
    out: Levels = {}
    for n in range(1, ORDER + 1):
        f = got[got["n"] == n].sort_values("key")
        counts, starts = np.zeros((len(f), CLASSES)), np.zeros((len(f), CLASSES))
        counts[:, 2], starts[:, 2] = f["many"], f["starts"]
        out[n] = *(f[c].to_numpy(dtype=np.int64) for c in ("key", "suffix", "context")), counts, starts
    return out


def consistent_label(general: str, specific: list[str], swearing: str):
    """True, False, or null without labels: a specific kind of abuse makes a row abusive; swearing alone leaves it to the general label; a general
    label without any kind is taken for an error of annotation."""
    some = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in specific]) > 0
    both = (F.coalesce(F.col(general), F.lit(0)) > 0) & (F.coalesce(F.col(swearing), F.lit(0)) > 0)
    unlabelled = F.greatest(*[F.col(c) for c in [general, swearing, *specific]]).isNull()
    return F.when(~unlabelled, some | both)


def scored(df: DataFrame, id_col: str, text: str, label, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, score, abusive, for every row.  label: a boolean expression, null where a row is not labelled.

    The models are fitted on at most ``sample_rows`` different labelled texts (the least by a seeded hash; all, if there
    are fewer) and on the n-gram counts of all different unlabelled texts, in 2 ** ``BIN_BITS`` hash bins an order.
    Null and empty texts score -9 and are not abusive; without labelled rows of both
    kinds all rows score 0.  Copies of one text get one score; texts of any length are read whole.
    """
    spark = df.sparkSession
    looks = build_table(spark)
    taught = df.select(F.col(text).alias("t"), label.alias("y")).where("t <> ''")
    votes: dict[str, list[int]] = {}
    of_text = taught.where("y IS NOT NULL").groupBy("t").agg(F.count_if("y").alias("yes"), F.count("y").alias("n"))
    for r in of_text.orderBy(F.xxhash64(F.lit(6), "t"), "t").limit(sample_rows).collect():
        v = votes.setdefault(plain_form(r["t"], looks), [0, 0])
        v[0], v[1] = v[0] + r["yes"], v[1] + r["n"]
    pairs = [(t, int(yes * 2 > n)) for t, (yes, n) in sorted(votes.items()) if t]
    kind = df.schema[id_col].dataType.simpleString()
    if len({y for _, y in pairs}) < 2:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(False).alias("abusive"))

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"form": [plain_form(t, looks) for t in f["t"]]})

    forms = cut(taught.where("y IS NULL").select("t").distinct().mapInPandas(plain, "form string").where("form <> ''").distinct())
    ordinary = None if forms.isEmpty() else lambda *given: ordinary_levels(forms, *given)
    model, threshold, _ = cross_fit([t for t, _ in pairs], [y for _, y in pairs], ordinary)

    fitted = spark.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 2000):
                part = f.iloc[lo : lo + 2000]
                forms = [plain_form(t, looks) if isinstance(t, str) else "" for t in part["t"]]
                s = fitted.value.stretches(forms)[0]
                yield pd.DataFrame({"id": part["id"], "score": s, "abusive": s > threshold})

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInPandas(score, f"id {kind}, score double, abusive boolean")
