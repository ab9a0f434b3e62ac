"""Files on any file system that Hadoop knows (local, HDFS, object stores), seen from the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(path: str):
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return bool(fs.exists(p))


def is_folder(path: str) -> bool:
    fs, p = _at(path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def names(path: str) -> list[str]:
    """Names in a folder, sorted."""
    fs, p = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def files_below(path: str) -> list[str]:
    """A file itself, or all files below a folder."""
    if not is_folder(path):
        return [path]
    return [f for n in names(path) for f in files_below(f"{path.rstrip('/')}/{n}")]


def read_text(path: str) -> str:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    fs, p = _at(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def digest(path: str) -> str:
    """SHA-256 of a file's bytes; a remote file is read by a task."""
    if "://" not in path:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    return SparkSession.active().read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
