"""Sinks: idempotent stage tables with sidecars, hashes, manifests, reports, run log."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import time
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.session import cut
from embertrace.sources import files
from embertrace.sources.schemas import PROCESSED, conform


@dataclass(frozen=True)
class WriteStats:
    path: str
    written: bool
    rows: int
    sources_hash: str


def file_hash(path: str) -> str:
    return files.digest(path)


def sources_hash(*paths: str) -> str:
    """Hash of the files' paths and contents, in path order; folders count with all their files."""
    every = sorted(f for p in paths for f in files.files_below(p))
    return hashlib.sha256("".join(f"{p}|{file_hash(p)}\n" for p in every).encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """An order-free fingerprint of the rows (part files aren't stable byte by byte): count and sum of row hashes."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{r[0]}|{r[1]}".encode()).hexdigest()


def folded_hash(parts: dict[str, str]) -> str:
    return hashlib.sha256("".join(f"{k}|{v}\n" for k, v in sorted(parts.items())).encode()).hexdigest()


def _sidecar(path: str) -> str:
    return path.rstrip("/") + ".meta.json"


def write_stage(df: DataFrame, path: str, hash_of_sources: str, *, overwrite: bool = False, schema=PROCESSED, partition_by: Sequence[str] = ()) -> WriteStats:
    """Conform and write, unless the sidecar says that the same sources were written already; a broken sidecar means writing again."""
    if not overwrite and files.exists(path):
        try:
            meta = json.loads(files.read_text(_sidecar(path)))
            if meta["sources_hash"] == hash_of_sources:
                return WriteStats(path, False, int(meta["rows"]), hash_of_sources)
        except (OSError, ValueError, KeyError, TypeError, Py4JJavaError):
            pass
    w = conform(df, schema).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    done = df.sparkSession.read.parquet(path)
    rows = done.count()
    files.write_text(_sidecar(path), json.dumps({"sources_hash": hash_of_sources, "rows": rows, "output_hash": content_hash(done), "schema": [x.name for x in schema.fields]}, indent=1))
    return WriteStats(path, True, rows, hash_of_sources)


def write_both_languages(df: DataFrame, english_path: str, other_path: str, hash_of_sources: str, overwrite: bool = False) -> tuple[WriteStats, WriteStats]:
    """Two complementary sinks by ``lang``; the other one is written even when empty.  The plan runs once: its result is cut."""
    df = cut(df)
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    return (write_stage(df.where(en), english_path, hash_of_sources, overwrite=overwrite), write_stage(df.where(~en), other_path, hash_of_sources, overwrite=overwrite))


def write_if_absent(df: DataFrame, path: str) -> bool:
    if files.exists(path):
        return False
    df.write.parquet(path)
    return True


def write_report(df: DataFrame, path: str) -> None:
    """A result table (at most a few thousand rows) as CSV, or as Markdown if the path ends in .md."""
    rows = [list(r) for r in df.collect()]
    if path.endswith(".md"):
        show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]
        files.write_text(path, "\n".join(lines) + "\n")
        return
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(df.columns)
    w.writerows(rows)
    files.write_text(path, out.getvalue())


def update_manifest(path: str, parts: dict[str, str]) -> dict:
    """Write the parts' hashes and their folded hash; returns what a differing earlier manifest said ({} if none)."""
    before = {}
    if files.exists(path):
        before = json.loads(files.read_text(path))
    now = {"parts": parts, "manifest_hash": folded_hash(parts)}
    files.write_text(path, json.dumps(now, indent=1, sort_keys=True))
    return before if before and before.get("manifest_hash") != now["manifest_hash"] else {}


class RunLog:
    """Named steps with rows and seconds, appended to a CSV (header on the first write)."""

    def __init__(self, step: str):
        self.step, self.began, self.notes = step, time.time(), {}

    def note(self, **x) -> None:
        self.notes |= x

    def save(self, path: str) -> None:
        new = not os.path.exists(path)
        with open(path, "a", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            if new:
                w.writerow(["step", "seconds", "notes"])
            w.writerow([self.step, f"{time.time() - self.began:.2f}", json.dumps(self.notes, sort_keys=True)])
