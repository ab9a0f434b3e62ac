"""Visually identical text with different characters: one consistent form per look.

Confusable letters are grouped into *look classes* by the skeletons of the Unicode security data that ships with Spark
(ICU): two letters share a class when they have the same skeleton and the same letter case category.
The table is built by rule on the driver (a few thousand letters whatever the input) and sent with the UDF.

For each token the resolved script sets of its letters are intersected:

* one script left: the token is written in it (a mixed-script spelling disappears);
* several left: a whole-script confusable; scripts that would need letters outside their everyday alphabet drop out, then
  it takes the script of the nearest unambiguous token, else Latin;
* none left: an irreducibly mixed token; letters go to the script that covers most of them, the rest stay.

Letters that a style sets apart to the eye (mathematical bold, circled digits, roman numeral signs) are another look and stay.
The table needs the classic session's JVM (ICU), not Spark Connect.  Every decision depends on look classes only, so strings that look the same get the same form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from embertrace.session import cut

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Georgian", "Cherokee", "Coptic", "Lisu")
EVERYDAY = {"Latin": (0x41, 0x24F), "Cyrillic": (0x410, 0x451), "Greek": (0x391, 0x3CE)}
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]+")
FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>")


def build_table(spark: SparkSession, upto: int = 0x1FFFF) -> dict[str, dict[str, str]]:
    """letter -> {script: that look class's letter in the script}, for letters with a look-alike in another script."""
    named = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]
    letters = []
    for n in range(0x41, upto):
        c = chr(n)
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c):
            script = next((s for s, p in named if p.match(c)), None)
            if script:
                letters.append((c, script))
    jvm = spark.sparkContext._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(c for c, _ in letters)).split("\n")
    classes: dict[tuple[str, str], dict[str, str]] = {}
    where: dict[str, tuple[str, str]] = {}
    for (c, script), skeleton in zip(letters, skeletons, strict=True):
        where[c] = (skeleton, unicodedata.category(c))
        phonetic = 0x250 <= ord(c) <= 0x2FF or 0x1D00 <= ord(c) <= 0x1DBF  # no script is spelled in these
        classes.setdefault(where[c], {}).setdefault("Phonetic" if phonetic else script, c)  # the lowest code point stands for its script
    for k in classes.values():
        if len(k) > 1:
            k.pop("Phonetic", None)
    return {c: classes[k] for c, k in where.items() if len(classes[k]) > 1 or classes[k] != {next(iter(classes[k])): c}}


@lru_cache(1 << 16)
def _script(c: str) -> str:
    for s in SCRIPTS:
        if regex.match(rf"\p{{Script={s}}}", c):
            return s
    return "Other"


@lru_cache(1 << 16)
def _fold(c: str) -> str:
    """Width variants and blanks; Latin ligatures; everything else stays."""
    if unicodedata.category(c) == "Zs" or c in "\t\n\r\x0b\x0c\x85":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(FOLDED_TAGS) or 0xFB00 <= ord(c) <= 0xFB06:
        return unicodedata.normalize("NFKC", c)
    return c


def consistent_form(text: str | None, looks: dict[str, dict[str, str]]) -> tuple[str | None, list[str]]:
    """The form and the kinds of irregularity that were seen."""
    if text is None:
        return None, []
    if text.isascii() and not any(ch < " " or ch == "\x7f" for ch in text):
        return text.strip(" "), []
    kinds = []
    t = IGNORABLE.sub("", text)
    if t != text:
        kinds.append("invisible")
    folded = "".join(map(_fold, t))
    if folded != t:
        kinds.append("width")
    if unicodedata.normalize("NFC", folded) != folded:
        kinds.append("combining")
    tokens = [unicodedata.normalize("NFD", x) for x in folded.strip(" ").split(" ")]
    resolved: list[tuple[str, set[str] | None]] = []
    for tok in tokens:
        sets = [set(looks[c]) if c in looks else {_script(c)} for c in tok if c.isalpha()]
        if not sets:
            resolved.append((tok, None))
            continue
        both = set.intersection(*sets)
        if len({_script(c) for c in tok if c.isalpha()}) > 1:
            kinds.append("mixed_script")
        if not both:
            count: dict[str, int] = {}
            for x in sets:
                for s in x:
                    count[s] = count.get(s, 0) + 1
            both = {max(count, key=lambda s: (count[s], s == "Latin", s))}
        elif len(both) > 1:
            usual = {s for s in both if s in EVERYDAY and all(EVERYDAY[s][0] <= ord(looks[c][s] if c in looks else c) <= EVERYDAY[s][1] for c in tok if c.isalpha())}
            both = usual or both
        resolved.append((tok, both))
    out = []
    sure = [(i, next(iter(both))) for i, (_, both) in enumerate(resolved) if both and len(both) == 1]
    for i, (tok, both) in enumerate(resolved):
        if both is None:
            out.append(tok)
            continue
        s = min(((abs(i - k), k, s) for k, s in sure if s in both), default=(0, 0, "Latin" if "Latin" in both else min(both)))[2] if len(both) > 1 else next(iter(both))
        if len(both) > 1 and any(_script(c) != s for c in tok if c.isalpha()):
            kinds.append("whole_script")
        spelled = []
        for c in tok:
            k = looks.get(c)
            spelled.append(c if not k else k.get(s) or k.get("Latin") or k[min(k)])
        out.append("".join(spelled))
    return unicodedata.normalize("NFC", " ".join(out)), sorted(set(kinds))


def with_consistent_form(df: DataFrame, column: str, out: str = "form", kinds: str | None = "kinds") -> DataFrame:
    """``df`` plus the consistent form of ``column`` (and the list of irregularities).

    Null stays null; '' and texts of blanks or invisible characters only become ''.  Case and accents are kept; a
    precomposed and a combining accent are one.  Runs of inner blanks keep their length.  Existing columns of the names
    ``out`` and ``kinds`` are replaced, others kept.
    """
    looks = build_table(df.sparkSession)
    kind = StructType([StructField("form", StringType()), StructField("kinds", ArrayType(StringType()))])

    @F.pandas_udf(kind)
    def form(s: pd.Series) -> pd.DataFrame:
        made = [consistent_form(x, looks) for x in s]
        return pd.DataFrame({"form": [m[0] for m in made], "kinds": [m[1] for m in made]})

    r = df.withColumn("_look", form.asNondeterministic()(F.col(column))).withColumn(out, F.col("_look.form"))  # so that no copy of the UDF is planned per field
    return (r.withColumn(kinds, F.col("_look.kinds")) if kinds else r).drop("_look")


def look_alike_classes(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, class (the least id of the look), n_spellings: one row per row with something visible.  Nothing is expanded to pairs."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).alias("text")).where("text IS NOT NULL AND text <> ''")
    texts = cut(with_consistent_form(rows.groupBy("text").agg(F.min("id").alias("first")), "text", kinds=None).where("form <> ''"))
    looks = texts.groupBy("form").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("n_spellings"))
    return rows.join(texts.join(looks, "form").select("text", "class", "n_spellings"), "text").select("id", "class", "n_spellings")


def look_alike_pairs(df: DataFrame, id_col: str, column: str, hot_rows: int = 2000, salts: int = 16) -> DataFrame:
    """Pairs of rows (``a`` < ``b``) whose text looks the same but has other code points.

    Null and '' texts, and texts with nothing visible, take no part.  The form is computed once per distinct text; only
    rows of looks with two or more spellings enter the self-join.  A look held by more than ``hot_rows`` rows is
    salted on one side.  Every pair is part of the defined result, so nothing is capped.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(column).alias("text")).where("text IS NOT NULL AND text <> ''")
    # cut: the form of each distinct text is computed once, though it is used for counts and for members
    spelled = cut(with_consistent_form(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "text", kinds=None).where("form <> ''"))
    many = spelled.groupBy("form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1")
    texts = spelled.join(many, "form").select("text", F.xxhash64("form").alias("h"), "form", "rows")
    members = rows.join(texts, "text")
    hot = F.col("rows") > hot_rows
    a = members.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0))
    b = members.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    b = b.select("form", "salt", F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    return a.join(b, ["form", "salt"]).where("id < id_b AND text <> text_b").select(F.col("id").alias("a"), F.col("id_b").alias("b"))
