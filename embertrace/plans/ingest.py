"""Entry point A: raw messages and matches to the processed table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions import context as C
from embertrace.functions import text as T
from embertrace.operators import joins as J
from embertrace.operators import rules as R
from embertrace.sources.schemas import PROCESSED, conform
from embertrace.session import cut, table


def clean(chat: DataFrame) -> DataFrame:
    """No wheel phrases; NFKC, stripped text; no empty ones; the lower-case copy."""
    c = chat.where(F.lower(F.coalesce("type", F.lit(""))) != "chatwheel").where("key IS NOT NULL")
    return c.withColumn("key", T.strip(T.nfkc("key"))).where("key <> ''").withColumn("key_lower", F.lower("key"))


def ingest(chat: DataFrame, metadata: DataFrame, leagues: DataFrame, patches: DataFrame, detector: str = "stopwords") -> DataFrame:
    """Clean, identify language, join matches (many to one), leagues and patches; the processed schema.

    Stateless but for the joins with reduced dimensions, so no message is ever multiplied or lost after cleaning.
    """
    c = R.language_columns(clean(chat), "key", detector)
    # the patch is looked up once a match, before the messages multiply it
    m = J.asof_clip(cut(J.keep_first(metadata, ["match_id"])), patches, "start_date_time", "date_start", "patch", "patch_name")
    j = J.many_to_one(c.drop("leagueid"), m, ["match_id"])
    j = J.dictionary_join(j, leagues.select("leagueid", "leaguename", C.tier(F.col("leaguename"), F.col("opendota_tier")).alias("tier")), "leagueid", {"tier": C.OTHER, "leaguename": ""})
    j = j.withColumns({
        "match_outcome_for_player": C.outcome(F.col("player_slot"), F.col("radiant_win")), "match_minute": C.minute(F.col("time")), "phase": C.phase(F.col("leaguename")),
        "year": F.year("start_date_time").cast("short"), "month": F.month("start_date_time").cast("byte"), "quarter": F.quarter("start_date_time").cast("byte")})
    return conform(j, PROCESSED)


def ingest_counts(spark: SparkSession, root: str) -> DataFrame:
    """The whole pipeline over the messages' raw columns, counted by what it derives."""
    chat = table(spark, root, "processed").select("match_id", "time", "type", "key", "slot", "player_slot", "leagueid", "source_folder")
    p = ingest(chat, table(spark, root, "metadata"), table(spark, root, "leagues"), table(spark, root, "patch_map"))
    return p.groupBy("source_folder", "lang", "lang_source", "tier", "match_outcome_for_player").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("n_matches"))


QUERIES = {"ingest_counts": ingest_counts}
ORACLES: dict[str, str] = {}
