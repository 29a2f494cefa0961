"""Small files and renames in whatever store Spark can reach."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: written under another name and renamed."""
    fs, p = _at(spark, path + ".partial")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, to = _at(spark, path)
    fs.delete(to, False)
    if not fs.rename(p, to):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def publish(spark: SparkSession, partial: str, path: str) -> None:
    """A finished folder gets its name; an existing one is never replaced."""
    fs, p = _at(spark, partial)
    _, to = _at(spark, path)
    if fs.exists(to):
        raise FileExistsError(path)
    if not fs.rename(p, to):
        raise OSError(f"can't publish {path}")


def digest(config) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, modified, sha256) of files: of a session's sources, or of both sides of a copy."""
    content = spark.read.format("binaryFile").load(list(paths))
    return content.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def copies_differ(spark: SparkSession, sources: list[str], staged: list[str]) -> DataFrame:
    """Pairs (source, copy) whose bytes differ, or one of which is missing."""
    name = F.regexp_extract("path", r"[^/]+$", 0).alias("name")
    a = fingerprints(spark, *sources).select(name, F.col("sha256").alias("source"))
    b = fingerprints(spark, *staged).select(name, F.col("sha256").alias("copy"))
    return a.join(b, "name", "full").where(~F.col("source").eqNullSafe(F.col("copy")))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and everything runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
