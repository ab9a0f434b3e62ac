"""Sources: raw chat and match files, annotator files, dimensions, public corpora, stage tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions import context as C
from embertrace.operators.joins import interval_ends
from embertrace.sources import files
from embertrace.sources.schemas import CHAT, METADATA, conform


def folders_with(root: str, folders: Sequence[str], *wanted: str) -> list[str]:
    """The folders that hold all the files; others are skipped by the caller's policy."""
    return [f for f in folders if all(files.exists(os.path.join(root, f, x)) for x in wanted)]


def _one_by_one(paths: Sequence[str]) -> list[str]:
    missing = [p for p in paths if not files.exists(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return list(paths)


def read_chat(spark: SparkSession, root: str, folders: Sequence[str], file: str = "chat.csv", multi_line: bool = True) -> DataFrame:
    """All folders in one scan with explicit types; ``source_folder`` comes from the file's path.

    With ``multi_line`` (line breaks inside quotes) a file is one task whatever its size; without, files are split.
    """
    df = spark.read.schema(CHAT).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(_one_by_one([os.path.join(root, f, file) for f in folders]))
    return df.withColumn("source_folder", F.regexp_extract("_metadata.file_path", rf"([^/]+)/{file.replace('.', chr(92) + '.')}$", 1))


def read_metadata(spark: SparkSession, root: str, folders: Sequence[str], file: str = "main_metadata.csv") -> DataFrame:
    """Kept columns that are there; values that don't parse are null."""
    out = None
    for path in _one_by_one([os.path.join(root, f, file) for f in folders]):
        raw = spark.read.option("header", True).csv(path)  # files may differ in columns
        one = conform(raw.select(*[c for c in METADATA.fieldNames() if c in raw.columns]), METADATA)
        out = one if out is None else out.unionByName(one)
    return out


def read_stage(spark: SparkSession, root: str, exclude_suffix: str = "_non_english", columns: Sequence[str] | None = None) -> DataFrame:
    """Union of the parquet tables below ``root`` in name order, without the excluded ones; an error if there is none."""
    names = sorted(n for n in files.names(root) if n.endswith(".parquet") and not n[: -len(".parquet")].endswith(exclude_suffix))
    if not names:
        raise FileNotFoundError(f"no stage table below {root}")
    df = spark.read.option("mergeSchema", True).parquet(*[os.path.join(root, n) for n in names])
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if files.exists(path) else None


def read_annotations(spark: SparkSession, root: str, labels: Sequence[str]) -> DataFrame:
    """All annotator files sample_<annotator>.csv as one long-lived table with sanitised labels."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(os.path.join(root, "sample_*.csv"))
    df = df.withColumn("annotator_id", F.regexp_extract("_metadata.file_name", r"sample_(.*)\.csv", 1))
    present = [c for c in labels if c in df.columns]
    df = df.withColumns({c: C.clean_binary(F.col(c)) for c in present})
    return df.withColumn("sentiment", C.clean_sentiment(F.col("sentiment"))) if "sentiment" in df.columns else df


def read_leagues(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    l = raw.select(F.col("leagueid").try_cast("long").alias("leagueid"), F.col("leaguename") if "leaguename" in raw.columns else F.lit(None).cast("string").alias("leaguename"), F.col("tier").alias("opendota_tier"))
    return l.withColumn("dota_tier", C.tier(F.col("leaguename"), F.col("opendota_tier")))


def read_patches(spark: SparkSession, path: str, float_names: bool = False) -> DataFrame:
    """patch, date_start, date_end.  Names stay strings; ``float_names`` shortens them as a number would be written."""
    p = spark.read.option("header", True).csv(path).select(F.col("patch"), F.try_to_timestamp("date").cast("timestamp_ntz").alias("date_start"))
    if float_names:
        p = p.withColumn("patch", F.coalesce(F.col("patch").try_cast("double").cast("string"), F.col("patch")))
    return interval_ends(p.where("date_start IS NOT NULL"), "date_start")


def name_tokens(df: DataFrame, column: str, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct lower-case tokens of entity names: the name, the name without blanks, its words of four letters and more, and extras."""
    low = F.lower(F.trim(F.col(column)))
    parts = F.filter(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1), lambda t: F.length(t) >= 4)
    t = df.select(F.explode(F.array_union(F.array(low, F.regexp_replace(low, r"[^a-z]+", "")), parts)).alias("token"))
    more = df.sparkSession.createDataFrame([(x,) for x in extra], "token string")
    return t.unionByName(more).where("token <> ''").distinct()


def read_label_table(spark: SparkSession, path: str, text: str, label: str, mapping: dict[str, str], header: bool = True, names: Sequence[str] = ()) -> DataFrame:
    """Public sentiment files: text, label by a mapping; rows with other labels are dropped."""
    df = spark.read.option("header", header).option("escape", '"').option("multiLine", True).csv(path)
    if names:
        df = df.toDF(*names)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.select(F.col(text).alias("text"), F.try_element_at(m, F.col(label).cast("string")).alias("label")).where("text IS NOT NULL AND label IS NOT NULL")


def read_toxicity_tables(spark: SparkSession, texts: str, labels: str | None, columns: Sequence[str]) -> DataFrame:
    """Toxicity files with text and labels, or a text file and a label file joined by id; rows with a label of -1 are dropped."""
    opt = lambda p: spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(p)
    df = opt(texts)
    if labels:
        df = df.drop(*columns).join(opt(labels), "id")
    df = df.withColumns({c: F.col(c).try_cast("int") for c in columns})
    return df.where(F.forall(F.array(*[F.coalesce(c, F.lit(0)) for c in columns]), lambda v: v != -1)).select(F.col("comment_text").alias("text"), *columns)


def load_config(path: str) -> dict:
    """A YAML (if the library is there) or JSON manifest."""
    import json

    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML manifests need the yaml library; use JSON") from e
        return yaml.safe_load(f)
