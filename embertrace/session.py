"""Session builder, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "embertrace", cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume: UTC, ANSI, AQE, Arrow."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("EMBERTRACE_DRIVER_MEMORY", "6g"),
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table below ``root``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own setting; where it is unset, a local one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="embertrace-checkpoint-")  # one process: nobody else needs it
    sc.setCheckpointDir(given)
    return given


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.  Eager: building a plan that is cut runs a job."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
