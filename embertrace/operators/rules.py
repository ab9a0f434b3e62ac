"""Language gates and prioritised rule labels as expressions: the first rule that applies decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.functions import text as T

SHORT_ENGLISH = r"^[A-Za-z0-9 \t._\-!?']+$"
STOP_WORDS = {
    "en": "the a is it to of and in you we they with what why not was this that for on", "es": "el la que de en un una por con los para no es lo se",
    "pt": "o a que de em um uma por com os para nao se do da no", "fr": "le la que de en un une par avec les pour ne est se du des",
    "de": "der die das und ist nicht ein eine mit den zu auf wir ich sie", "id": "yang di dan itu ini tidak dengan untuk dari kita saya sudah lagi",
}
#: Words that only Indonesian chat has, and its function words.
STRONG_ID = tuple((
    "wkwk wkwkwk mantap cupu gabut mabar gass lu gw gue gua lo sih dong deh kok banget bgt aja doang kalo klo nggak ngga gak udah udh dah belum blm jangan jgn "
    "kenapa knp gimana gmn gausah percuma bro gan om mas kak cuy beng mksh makasih maaf punten parah").split())
WEAK_ID = tuple((
    "yang sama sm dgn utk untuk dari dr ke di saya aku kamu anda kita kami mereka dia lu lo elu gw gue gua gwa tidak ngga nggak gak ga kagak engga enggak gk tak "
    "sih dong deh kok kan aja doang lagi lg masih msh terus trs udah udh dah belum blm blom bgt banget bisa bs mau pengen pgn kalo kalau klo ada gada punya jadi jd biar "
    "kenapa knp gimana gmn apa apaan siapa mana main maen menang mng kalah klh lawan lwn parah mantap mantul mantab cupu gabut anjr njir lah kek gas gass mabar "
    "bro brok bg gan om mas mbak kak cuy beng bang sabar tenang santai maaf mf punten makasih mksh mksih salah gausah percuma").split())
#: Parts of Indonesian messages that decide a proposal, in the order of the cascade.
PROPOSALS = (
    ("negative", "high", "complaint", ("cupu", "parah", "gabut", "percuma", "gausah")),
    ("borderline", "ASK", "borderline", (
        "mati aja", "mati lu", "gue muted", "gua muted", "bisulan", "ngmng doang", "ngomong doang", "ngomong aja", "kamu ngmng", "kamu doang", "muncrat", "jahat",
        "goblog", "bodoh", "jelek", "ngebacot", "ngebacooot")),
    ("neutral", "high", "break", (
        "maghrib", "sholat", "mandi dulu", "mandi dl", "mandi sek", "makan dl", "makan dulu", "makan sek", "pulang dulu", "pergi dl", "pergi dulu", "wc dl", "wc dulu", "toilet")),
    ("positive", "high", "friendly", (
        "mantap", "mantul", "mantab", "sabar bang", "sabar bro", "tenang", "sippp", "sip ", "sip!", "oke deh", "okee deh", "takpe", "mksh", "makasih", "maaf", "punten")),
)
QUESTION_ID = r"\b(kenapa|knp|gimana|gmn|siapa|mana)\b|[?]"


def is_short_english(c: Column, most: int = 5) -> Column:
    """At most ``most`` tokens of plain ASCII words count as English."""
    return (F.size(T.tokens(c)) <= most) & F.coalesce(c, F.lit("")).rlike(SHORT_ENGLISH)


def stop_word_language(c: Column) -> Column:
    """Deterministic default detector: the language with most stop words (first of equals), Cyrillic is ru, else und."""
    def most(toks: Column) -> Column:
        hits = lambda words: F.size(F.filter(toks, lambda t: t.isin(*words.split())))
        return F.greatest(*[F.struct(hits(words).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, words) in enumerate(STOP_WORDS.items())])

    best = F.transform(F.array(T.tokens(F.lower(F.coalesce(c, F.lit(""))))), most)[0]  # binds the tokens, so they are split once
    return F.when(F.coalesce(c, F.lit("")).rlike(r"[\x{0400}-\x{04FF}]"), "ru").when(best["n"] > 0, best["lang"]).otherwise("und")


DETECTORS: dict[str, tuple[object, bool]] = {"stopwords": (stop_word_language, True)}


def register_detector(name: str, detect, is_expression: bool = False) -> None:
    """``detect``: Column -> Column if ``is_expression``, else a list of texts -> list of codes, run as an Arrow UDF."""
    DETECTORS[name] = (detect, is_expression)


def detect_language(c: Column, detector: str = "stopwords") -> Column:
    """The detector's code; empty texts and failures of a plug-in give 'und'; an unknown detector is an error."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}; known: {sorted(DETECTORS)}")
    d, is_expression = DETECTORS[detector]
    if is_expression:
        return d(c)

    def batch(s: pd.Series) -> pd.Series:
        some = s.notna() & (s != "")
        try:  # the whole batch at once; text by text only if that fails
            found = pd.Series(d(s[some].tolist()), index=s.index[some], dtype=object)
            return found.reindex(s.index).map(lambda x: x or "und", na_action=None).fillna("und") if len(found) else pd.Series("und", index=s.index)
        except Exception:  # noqa: BLE001
            pass

        def one(t):
            try:
                return (d([t])[0] or "und") if t else "und"
            except Exception:  # noqa: BLE001 - a detector's failure is a result
                return "und"
        return s.map(one)

    return F.pandas_udf(batch, "string")(c)


def language_columns(df: DataFrame, text: str, detector: str = "stopwords", most: int = 5) -> DataFrame:
    """``lang`` and ``lang_source`` (short_circuit or the detector); filter on lang == 'en' for the two outputs."""
    short = is_short_english(F.col(text), most)
    return df.withColumn("lang", F.when(short, "en").otherwise(detect_language(F.col(text), detector))).withColumn("lang_source", F.when(short, "short_circuit").otherwise(detector))


def marker_languages(c: Column) -> Column:
    """Tags of the languages whose markers occur: one hit is enough for ru, fil, vi; es needs two."""
    toks = T.tokens(F.lower(F.coalesce(c, F.lit(""))))
    hits = lambda ws: F.size(F.filter(toks, lambda t: t.isin(*ws)))
    return F.array_compact(F.array(
        F.when((hits(("blyat", "suka", "cyka", "davai", "chto", "esli")) > 0) | F.coalesce(c, F.lit("")).rlike(r"[\x{0400}-\x{04FF}]"), "ru"),
        F.when(hits(("putangina", "bobo", "gago", "tanga")) > 0, "fil"),
        F.when(hits(("vcl", "dkm", "ngu")) > 0, "vi"),
        F.when(hits(("que", "el", "los", "por", "una", "con")) >= 2, "es"),
    ))


def is_indonesian(c: Column) -> Column:
    """Any strong marker, or two tokens and more of which at least 30 % are markers."""
    toks = T.alpha_tokens(F.coalesce(c, F.lit("")))
    strong = F.exists(toks, lambda t: t.isin(*STRONG_ID))
    share = F.size(F.filter(toks, lambda t: t.isin(*STRONG_ID, *WEAK_ID))) / F.nullif(F.size(toks), F.lit(0))
    return strong | F.coalesce((F.size(toks) >= 2) & (share >= 0.3), F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column
    sentiment: str
    flags: tuple[str, ...] = ()
    note: str = ""


class RuleSet:
    """Rules in order of priority; the first whose condition holds labels the row."""

    def __init__(self, rules: Sequence[Rule], flags: Sequence[str]):
        self.rules, self.flags = list(rules), list(flags)

    def label(self) -> Column:
        """struct(category, sentiment, one int per flag, note); null where no rule applies."""
        out = None
        for r in reversed(self.rules):
            s = F.struct(F.lit(r.name).alias("category"), F.lit(r.sentiment).alias("sentiment"),
                         *[F.lit(int(f in r.flags)).alias(f) for f in self.flags], F.lit(r.note).alias("note"))
            out = F.when(F.coalesce(r.when, F.lit(False)), s) if out is None else F.when(F.coalesce(r.when, F.lit(False)), s).otherwise(out)
        return out


TOX = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")


def chat_rules(key: str = "key", outcome: str = "match_outcome_for_player", time: str = "time", duration: str = "duration") -> RuleSet:
    """The compact rule set for in-match chat."""
    s = T.norm_strict(F.coalesce(F.col(key), F.lit("")))
    toks = T.alpha_tokens(F.coalesce(F.col(key), F.lit("")))
    toxic = F.arrays_overlap(toks, F.array(*[F.lit(b) for b in T.BLOCKERS]))
    ratio = F.col(time) / F.nullif(F.col(duration), F.lit(0))
    ez = s.rlike(r"^e+z+(gg|mid|game|wp)*$")
    gg = s.rlike(r"^g+g+(wp)?$")
    rules = [
        Rule("insult", toxic & (F.size(toks) <= 3), "negative", ("toxic", "insult")),
        Rule("ez_win", ez & (F.col(outcome) == "win"), "negative", ("toxic", "insult"), "taunt by the winner"),
        Rule("ez_other", ez, "neutral", (), "ambiguous"),
        Rule("forfeit", s.rlike(r"^(ff|gg?ff|forfeit)$"), "negative"),
        Rule("obscene", F.coalesce(F.col(key), F.lit("")).rlike(T.PROFANITY), "negative", ("toxic", "obscene")),
        Rule("coordination", s.rlike(r"^(go|push|mid|rosh|b|back|smoke|goend|end|ss|re|wait|ready)$"), "neutral"),
        Rule("apology", s.rlike(r"^(sry|sorry|mb|mybad)$"), "neutral"),
        Rule("acknowledge", s.rlike(r"^(ok|okay|k|yes|no|np|ty|thx|thanks|sure)$"), "neutral"),
        Rule("technical", s.rlike(r"^(pause|unpause|lag|lags|dc|brb|afk|sec)$"), "neutral"),
        Rule("laughter", s.rlike(r"^(x+d+|l+o+l+|lmao|(ha)+h?)$"), "positive"),
        Rule("sport", s.rlike(r"^(wp|ggwp|nice|gj|wellplayed|glhf|wow)$"), "positive"),
        Rule("gg_end", gg & (ratio >= 0.95), "positive", (), "closing"),
        Rule("gg_late", gg & (ratio >= 0.85), "neutral", (), "late"),
        Rule("gg_early", gg, "negative", (), "giving up early"),
        Rule("punctuation", s.rlike(r"^[^a-z0-9]*$"), "neutral"),
    ]
    return RuleSet(rules, TOX)


def score_in_batches(df: DataFrame, keys: Sequence[str], text: str, load, labels: Sequence[str]) -> DataFrame:
    """Plug-in scorer: ``load()`` runs once per task and returns texts -> rows of probabilities; keys travel with the rows."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + [f"prob_{x} double" for x in labels])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            p = pd.DataFrame(model(f[text].fillna("").tolist()), columns=[f"prob_{x}" for x in labels], index=f.index)
            yield pd.concat([f[list(keys)], p], axis=1)

    return df.select(*keys, text).mapInPandas(run, schema)


def lexicon_scorer():
    """A deterministic scorer: the share of blocked words, squashed."""
    def score(texts: list[str]) -> list[tuple[float]]:
        out = []
        for t in texts:
            ws = t.lower().split()
            out.append((min(1.0, 2.0 * sum(w.strip("!?.,") in T.BLOCKERS for w in ws) / max(len(ws), 1)),))
        return out

    return score


def propose_indonesian(c: Column) -> Column:
    """(label, confidence, reason) for Indonesian messages, by the first part that occurs: laughter, ``PROPOSALS`` in order, questions, else talk."""
    low = F.lower(c)
    say = lambda a, b, r: F.struct(F.lit(a).alias("label"), F.lit(b).alias("confidence"), F.lit(r).alias("reason"))
    out = F.when(low.isNull(), say("neutral", "low", "no text")).when(low.rlike(r"\bwkwk"), say("positive", "high", "laughter"))
    for label, confidence, reason, parts in PROPOSALS:
        out = out.when(low.rlike("|".join(parts)), say(label, confidence, reason))
    return out.when(low.rlike(QUESTION_ID), say("neutral", "medium", "question")).otherwise(say("neutral", "medium", "talk"))


def apply_proposals(df: DataFrame, text: str, proposal: str, corrections: DataFrame) -> DataFrame:
    """Column ``label``: a correction of the exact text (columns text, corrected) decides where asked for; high confidence stands
    unless corrected; medium stands as proposed; ASK without a correction is neutral; low stays unlabelled."""
    one = corrections.groupBy(F.col("text").alias("_t")).agg(F.min("corrected").alias("_c"))
    j = df.join(one, F.col(text) == F.col("_t"), "left")
    conf, own = F.col(f"{proposal}.confidence"), F.col(f"{proposal}.label")
    label = F.when(conf == "ASK", F.coalesce("_c", F.lit("neutral"))).when(conf == "high", F.coalesce("_c", own)).when(conf == "medium", own)
    return j.withColumn("label", label).drop("_t", "_c")
