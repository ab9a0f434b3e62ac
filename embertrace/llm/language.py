"""Missing or wrong language labels: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary.  The score of a word is the probability summed over *all*
ways to segment it into pieces (a forward algorithm), so no single segmentation is committed to.  The probabilities are
fitted by expectation-maximisation (forward-backward piece counts) on a bounded sample, first with the delivered labels, then with
the segments found, which removes wrong labels and mixed rows from the statistics.

A text is cut into stretches of one language by dynamic programming over its words: a stretch has at least
``LEAST_WORDS`` words (or is the whole text), and a change of language costs ``CHANGE`` nats, less at punctuation.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.lookalike import build_table, consistent_form

LANGUAGES = ("en", "id", "es", "ru", "pt", "de", "fr")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LEAST_WORDS = 4
CHANGE = 9.0
CHANGE_AT_BREAK = 4.0
MARGIN = 5.0
SAMPLE_ROWS = 12_000
ROUNDS = 3
PRIOR = 200.0
UNKNOWN = 1e-6
USUAL_WORDS = 12  # a row teaches in proportion to the square root of its length; one of so many words counts each word once
LONGEST = 48  # longer words are summed in logs, and their scores not remembered
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
APART = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?!\S)")  # a word spelled letter by letter
BREAK = re.compile(r"(^|[^\w\s'’])$|[.!?,;:|\-–—]$")


def words_of(form: str) -> tuple[list[str], list[bool]]:
    """Lower-case words ('' for tokens without letters), and whether a break stands before each."""
    out, breaks, after = [], [], False
    for t in APART.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), form.lower()).split():
        w = EDGE.sub("", t)
        if not w:
            after = True  # a lone dash or bar
            continue
        out.append(w if any(c.isalpha() for c in w) else "")
        breaks.append(after)
        after = bool(BREAK.search(t))
    return out, breaks


class Unigrams:
    """Piece probabilities of the languages: piece -> vector."""

    def __init__(self, pieces: dict[str, np.ndarray], longest: int, k: int = len(LANGUAGES)):
        self.pieces, self.longest, self.k = pieces, longest, k
        self.none = np.full(k, UNKNOWN)
        self.memory: dict[str, np.ndarray] = {}

    def arcs(self, s: str, j: int) -> list[tuple[int, str | None, np.ndarray]]:
        """What may end at place j: (start, piece or None for an unknown letter, probabilities)."""
        out = [(i, s[i:j], p) for i in range(max(0, j - self.longest), j) if (p := self.pieces.get(s[i:j])) is not None]
        if not out or out[-1][0] < j - 1:
            out.append((j - 1, None, self.none))
        return out

    def lattice(self, word: str) -> tuple[str, list[list[tuple[int, str | None, np.ndarray]]]]:
        s = "▁" + word
        return s, [[], *[self.arcs(s, j) for j in range(1, len(s) + 1)]]

    def long_score(self, word: str) -> np.ndarray:
        """``score`` of a word of any length; keeps the last few places only."""
        s, a = "▁" + word, deque([np.zeros(self.k)], maxlen=self.longest)
        for j in range(1, len(s) + 1):
            a.append(np.logaddexp.reduce([a[i - j] + np.log(np.maximum(p, 1e-300)) for i, _, p in self.arcs(s, j)]))
        return a[-1]

    def score(self, word: str) -> np.ndarray:
        """Log-probability of the word in each language, over all segmentations; zeros for ''."""
        if len(word) > LONGEST:
            return self.long_score(word)
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            if not word:
                got = np.zeros(self.k)
            else:
                s, into = self.lattice(word)
                a = [np.ones(self.k)]
                for j in range(1, len(s) + 1):
                    total = np.zeros(self.k)
                    for i, _, p in into[j]:
                        total = total + a[i] * p
                    a.append(total)
                got = np.log(a[-1] + 1e-300)
            self.memory[word] = got
        return got

    def expect(self, word: str, weight: np.ndarray, counts: dict[str, np.ndarray]) -> None:
        """Add the expected piece counts of a word that was seen ``weight`` times in each language."""
        s, into = self.lattice(word)
        n = len(s)
        if len(word) > LONGEST:
            into = [[(i, piece, np.log(np.maximum(p, 1e-300))) for i, piece, p in x] for x in into]
            a = [np.zeros(self.k)]
            for j in range(1, n + 1):
                a.append(np.logaddexp.reduce([a[i] + p for i, _, p in into[j]]))
            b = [np.full(self.k, -np.inf) for _ in range(n)] + [np.zeros(self.k)]
            for j in range(n, 0, -1):
                for i, _, p in into[j]:
                    b[i] = np.logaddexp(b[i], p + b[j])
            share = lambda i, p, j: np.exp(a[i] + p + b[j] - a[n]) * weight
        else:
            a = [np.ones(self.k)]
            for j in range(1, n + 1):
                a.append(sum((a[i] * p for i, _, p in into[j]), np.zeros(self.k)))
            b = [np.zeros(self.k) for _ in range(n)] + [np.ones(self.k)]
            for j in range(n, 0, -1):
                for i, _, p in into[j]:
                    b[i] = b[i] + p * b[j]
            z = weight / np.maximum(a[n], 1e-300)
            share = lambda i, p, j: a[i] * p * b[j] * z
        for j in range(1, n + 1):
            for i, piece, p in into[j]:
                if piece is not None:
                    c = share(i, p, j)
                    if piece in counts:
                        counts[piece] += c
                    else:
                        counts[piece] = c


def load_pieces(path: str = MODEL) -> dict[str, float]:
    """The vocabulary's ordinary pieces (lower-cased ones count once) with equal weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    out = {p.lower() for p in out}
    return dict.fromkeys(out, 1.0 / len(out))


def segments(score: np.ndarray, breaks: Sequence[bool]) -> list[tuple[int, int, int]]:
    """(first, end, language) stretches that maximise the score less the costs of changes."""
    n = len(score)
    if n < 2 * LEAST_WORDS:
        return [(0, n, int(score.sum(axis=0).argmax()))] if n else []
    cum = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, axis=0)])
    best = np.full((n + 1, score.shape[1]), -np.inf)
    back = np.zeros((n + 1, score.shape[1]), dtype=np.int64)  # where the stretch that ends here began
    best[LEAST_WORDS] = cum[LEAST_WORDS]
    tops = [(-np.inf, 0)] * (n + 1)
    tops[LEAST_WORDS] = (float(best[LEAST_WORDS].max()), int(best[LEAST_WORDS].argmax()))
    for j in range(LEAST_WORDS + 1, n + 1):
        stay = best[j - 1] + score[j - 1]
        back[j] = back[j - 1]
        i = j - LEAST_WORDS
        if i >= LEAST_WORDS:
            enter = tops[i][0] - (CHANGE_AT_BREAK if breaks[i] else CHANGE) + cum[j] - cum[i]
            enter[tops[i][1]] = -np.inf
            new = enter > stay
            back[j][new] = i
            stay = np.where(new, enter, stay)
        best[j] = stay
        tops[j] = (float(stay.max()), int(stay.argmax()))
    out, j, lang = [], n, tops[n][1]
    while j > 0:
        i = int(back[j][lang])
        out.append((i, j, lang))
        j, lang = i, tops[i][1]
    return out[::-1]


def fit(rows: list[tuple[str, str | None]], pieces: dict[str, float], languages: Sequence[str] = LANGUAGES) -> Unigrams:
    """EM on (form, label) rows; labels outside ``languages`` teach nothing in the first round."""
    longest = max(map(len, pieces))
    k = len(languages)
    texts = [(words_of(f), label) for f, label in rows]
    model = Unigrams({p: np.full(k, w) for p, w in pieces.items()}, longest, k)
    for r in range(ROUNDS + 1):
        seen: dict[str, np.ndarray] = {}
        for (words, breaks), label in texts:
            if r == 0:
                if label not in languages:
                    continue
                spans = [(0, len(words), list(languages).index(label))]
            else:
                if not words:
                    continue
                spans = segments(np.array([model.score(w) for w in words]), breaks)
            for i, j, lang in spans:
                if r and j - i < LEAST_WORDS:
                    continue
                for w in words[i:j]:
                    if w:
                        if w not in seen:
                            seen[w] = np.zeros(k)
                        seen[w][lang] += (USUAL_WORDS / len(words)) ** 0.5
        counts: dict[str, np.ndarray] = {}
        for w, n in seen.items():
            model.expect(w, n, counts)
        total = sum(counts.values(), np.zeros(k))
        pooled = {p: float(c.sum()) for p, c in counts.items()}
        all_counts = max(sum(pooled.values()), 1e-9)
        uniform = 1.0 / len(pieces)
        model = Unigrams({p: (counts.get(p, 0.0) + PRIOR * (0.9 * pooled.get(p, 0.0) / all_counts + 0.1 * uniform)) / (total + PRIOR) for p in pieces}, longest, k)
    return model


def identified(df: DataFrame, id_col: str, text: str, label: str, path: str = MODEL, sample_rows: int = SAMPLE_ROWS, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """id, segment, first_word, n_words, lang, confidence: one row per stretch of one language.

    confidence: the posterior of the language over the stretch with equal priors.  Null and empty texts and texts
    without words give one row with null language and confidence 0.  A text that says nothing about its language
    (names, numbers) gets low confidence.  Texts of any length are read whole.  Fitted on at most ``sample_rows`` labelled rows,
    the least by a seeded hash of the id.
    """
    looks = build_table(df.sparkSession)
    rows = df.select(F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(F.lit(4), id_col).alias("r"))
    taught = rows.where(F.col("l").isin(list(languages)) & (F.col("t") != "")).orderBy("r", "t").limit(sample_rows).collect()
    model = fit([(consistent_form(r["t"], looks)[0], r["l"]) for r in taught], load_pieces(path), languages)
    model.memory = {}
    shipped = df.sparkSession.sparkContext.broadcast(model)  # pieces of a fixed vocabulary by languages
    kind = df.schema[id_col].dataType.simpleString()
    names = np.array(languages)

    def identify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for f in frames:
            out = []
            for i, t in zip(f["id"], f["t"], strict=True):
                words, breaks = words_of(consistent_form(t, looks)[0]) if isinstance(t, str) else ([], [])
                if not words:
                    out.append((i, 0, 0, 0, None, 0.0, 0.0))
                    continue
                s = np.array([model.score(w) for w in words])
                for k, (a, b, lang) in enumerate(segments(s, breaks)):
                    x = s[a:b].sum(axis=0)
                    e = np.exp(x - x.max())
                    second = np.partition(x, -2)[-2]
                    out.append((i, k, a, b - a, names[lang], float(e[lang] / e.sum()), float(x[lang] - second)))
            yield pd.DataFrame(out, columns=["id", "segment", "first_word", "n_words", "lang", "confidence", "margin"])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInPandas(
        identify, f"id {kind}, segment int, first_word int, n_words int, lang string, confidence double, margin double")


def label_cases(found: DataFrame, labels: DataFrame, id_col: str, label: str, missing: Sequence[str] = ("", "und")) -> DataFrame:
    """id, lang: languages of stretches of at least LEAST_WORDS words whose row has no label or another."""
    sure = found.where((F.col("n_words") >= LEAST_WORDS) & (F.col("margin") >= MARGIN)).select("id", F.col("lang").alias("found"))
    l = labels.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(label))).alias("label"))
    return sure.join(l, "id").where(F.col("label").isNull() | F.col("label").isin(list(missing)) | (F.col("label") != F.col("found"))).select("id", F.col("found").alias("lang")).distinct()
