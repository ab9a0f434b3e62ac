"""Queries of problem 3: the patch of each match as known at its start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.operators.asknown import as_known_join
from embertrace.session import cut, table


def matches_with_patch(spark: SparkSession, root: str) -> DataFrame:
    """match_id, start_date_time, least and greatest stamped name, and the right ``patch`` (null: none in force).

    One row per match: stamps and start times are combined map-side before the only shuffle of the big table; whether all
    stamps of a match are right shows in the least and greatest of them, so no set of stamps is kept.
    """
    stamps = table(spark, root, "processed").select("match_id", "start_date_time", "patch_name")
    starts = table(spark, root, "metadata").select("match_id", "start_date_time", F.lit(None).cast("string").alias("patch_name"))
    m = stamps.unionByName(starts).where("match_id IS NOT NULL").groupBy("match_id").agg(
        F.min("start_date_time").alias("start_date_time"), F.min("patch_name").alias("least_name"), F.max("patch_name").alias("greatest_name"))
    m = cut(m)  # a row a match: the big table is read once
    return as_known_join(
        m, table(spark, root, "patch_map"), event_time="start_date_time", valid_from="date_start",
        valid_to=F.expr("date_end + INTERVAL 1 SECOND"), known_at="known_at", value="patch", out="patch")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    m = matches_with_patch(spark, root)
    return m.where("patch IS NOT NULL AND (least_name <> patch OR greatest_name <> patch)").select("match_id", "patch")


def p3_patches(spark: SparkSession, root: str) -> DataFrame:
    """Every match that has a start with its right patch (null where none was in force)."""
    return matches_with_patch(spark, root).where("start_date_time IS NOT NULL").select("match_id", "start_date_time", "patch")


def p3_stamp_report(spark: SparkSession, root: str) -> DataFrame:
    """By right patch: matches, and matches with a wrong stamp."""
    m = matches_with_patch(spark, root).where("patch IS NOT NULL")
    wrong = F.coalesce((F.col("least_name") != F.col("patch")) | (F.col("greatest_name") != F.col("patch")), F.lit(False))
    return m.groupBy("patch").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(wrong).alias("n_wrong"))


_RIGHT = """
WITH s AS (
  SELECT match_id, min(start_date_time) AS st, min(patch_name) AS lo, max(patch_name) AS hi FROM (
    SELECT match_id, start_date_time, patch_name FROM processed
    UNION ALL SELECT match_id, start_date_time, NULL FROM metadata) WHERE match_id IS NOT NULL GROUP BY match_id),
p AS (SELECT DISTINCT patch, date_start, date_end, known_at FROM patch_map),
r AS (
  SELECT match_id, patch FROM (
    SELECT s.match_id, p.patch, row_number() OVER (PARTITION BY s.match_id
      ORDER BY p.date_start DESC, coalesce(p.known_at, p.date_start) DESC, p.patch DESC) AS k
    FROM s JOIN p ON p.date_start <= s.st AND s.st < p.date_end + INTERVAL 1 SECOND AND (p.known_at IS NULL OR p.known_at <= s.st))
  WHERE k = 1)
"""

QUERIES = {"p3_found": p3_found, "p3_patches": p3_patches, "p3_stamp_report": p3_stamp_report}
ORACLES = {
    "p3_found": _RIGHT + """SELECT DISTINCT x.match_id, r.patch FROM processed x JOIN r ON r.match_id = x.match_id
WHERE x.patch_name IS NOT NULL AND x.patch_name <> r.patch""",
    "p3_patches": _RIGHT + "SELECT s.match_id, s.st AS start_date_time, r.patch FROM s LEFT JOIN r ON r.match_id = s.match_id WHERE s.st IS NOT NULL",
    "p3_stamp_report": _RIGHT + """SELECT r.patch, count(*) AS n_matches,
  count(*) FILTER (WHERE coalesce(s.lo <> r.patch OR s.hi <> r.patch, false)) AS n_wrong
FROM s JOIN r ON r.match_id = s.match_id GROUP BY r.patch""",
}
