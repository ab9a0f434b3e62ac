"""Text functions: normal forms, tokens, dictionary rewriting, lexicons.  All but NFKC are JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white space code point that Python's strip() removes, for engines whose \s is ASCII only.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PROFANITY = r"(?i)\b(fuck\w*|shit\w*|bitch\w*|idiot\w*|moron\w*|noob\w*|trash|garbage|goblok|anjing|bego|tolol|kontol)\b"
BLOCKERS = ("idiot", "moron", "trash", "garbage", "noob", "fuck", "shit", "scum", "clown", "loser", "goblok", "anjing")
#: Chat shorthand and its plain reading; later groups win, so an insult overrides a lane of the same name.
SLANG = {
    "gg": "good game", "ggwp": "good game well played", "wp": "well played", "glhf": "good luck have fun", "ty": "thank you", "thx": "thanks",
    "np": "no problem", "mb": "my bad", "gj": "good job", "nvm": "never mind", "idk": "i do not know", "brb": "be right back", "afk": "away",
    "lol": "laughing", "lmao": "laughing", "omg": "oh my god", "wtf": "what the fuck", "pls": "please", "plz": "please", "u": "you", "ur": "your",
    "r": "are", "y": "why", "bot": "bottom lane", "mid": "middle lane", "top": "top lane", "rosh": "roshan", "smoke": "smoke of deceit", "tp": "teleport",
    "b": "back", "re": "returned", "ss": "missing", "ez": "easy", "sry": "sorry", "ff": "forfeit", "noob": "bad player", "trash": "bad", "stfu": "shut up",
}
SLANG |= {"bot": "bad player", "rat": "bad player"}
PHRASES = {"well played": "good performance", "go end": "finish the game", "my bad": "sorry", "no problem": "fine", "good luck": "good wishes", "shut up": "be silent"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "" if not isinstance(t, str) else t if t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """NFKC; null becomes ''.  ASCII texts pass untouched."""
    return F.pandas_udf(_nfkc_batch, "string").asNondeterministic()(c)  # so that a filter on the result makes no second copy of the UDF


def norm_full(c: Column) -> Column:
    """Lower, strip, single blanks."""
    return F.regexp_replace(strip(F.lower(c)), f"{SPACE}+", " ")


def norm_strict(c: Column) -> Column:
    """Lower, without white space and common punctuation."""
    return F.regexp_replace(F.lower(c), r"""[!.?,~\s"']+""", "")


def tokens(c: Column) -> Column:
    """White space tokens; '' has none."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def alpha_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)


def bigrams(toks: Column) -> Column:
    """Adjacent tokens joined by a blank; an empty array for fewer than two."""
    n = F.size(toks)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(1))), F.slice(toks, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def translate_slang(c: Column, slang: dict[str, str] = SLANG, phrases: dict[str, str] = PHRASES) -> Column:
    """Phrases first (longest first, protected from the token pass), then tokens; all-punctuation texts stay in lower case.

    A token is looked up without its outer punctuation: a known one is replaced whole, an unknown one is kept as it is, and
    pure punctuation is dropped.
    """
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    order = sorted(phrases, key=lambda p: (-len(p), p))
    marked = reduce(lambda acc, ip: F.regexp_replace(acc, rf"\b{ip[1]}\b", f"\u0001{ip[0]}\u0001"), enumerate(order), low)
    readings = literal_map(slang | {f"\u0001{i}\u0001": phrases[p] for i, p in enumerate(order)})

    def one(t: Column) -> Column:
        core = F.regexp_replace(t, r"^[^\w\x{01}\x{80}-\x{10FFFF}]+|[^\w\x{01}\x{80}-\x{10FFFF}]+$", "")
        return F.when(core == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(readings, core), t))

    out = F.array_join(F.filter(F.transform(tokens(marked), one), lambda t: t != ""), " ")
    return F.when(out == "", low).otherwise(out)


def slang_hits(c: Column, slang: dict[str, str] = SLANG, phrases: dict[str, str] = PHRASES) -> tuple[Column, Column, Column]:
    """(tokens, known tokens, whether the text has a known token or a phrase as a plain substring)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    toks = F.transform(tokens(low), lambda t: F.regexp_replace(t, r"^[^\w\x{80}-\x{10FFFF}]+|[^\w\x{80}-\x{10FFFF}]+$", ""))
    known = F.size(F.filter(toks, lambda t: t.isin(*sorted(slang))))
    phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in sorted(phrases)])
    return F.size(toks), known, (known > 0) | phrase


def first_hit(c: Column, patterns: list[str]) -> Column:
    """The first match of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit("")) for p in patterns])
