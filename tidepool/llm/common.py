"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and all executors are in the driver's own
    process (local mode, as in tests) a temporary folder is made and kept for the
    life of the session; on a cluster the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidepool/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    Unlike a local checkpoint the files outlive any executor, and unlike
    ``checkpoint()`` they are compressed and can be read by column.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The POSIX path of a ``file:`` URI or plain path; None for any other store."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def text_of(column: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't got, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker, where the session has Spark's own 64 MB.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in small batches; when a task ends, its worker, which lives on, gives memory back.

    Spark takes the batch size from the session, so it is set there, unless somebody has set it before.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 << 20):
        conf.set(key, str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


#: A key is hot if it holds over 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1024


def join_held(rows: DataFrame, held: DataFrame, key: str, count: str) -> DataFrame:
    """Join every row with the one row of ``held`` for its key, whose rows ``count`` tells.

    Hot keys are few by definition and go by broadcast; no key of the rest is
    large, so the sort-merge join that takes it is even.
    """
    total = held.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = held.where(is_hot)
    few = F.broadcast(hot.select(F.col(key).alias("__hot")))
    marked = rows.join(few, F.col(key) == F.col("__hot"), "left")
    found = marked.where("__hot is not null").drop("__hot").join(F.broadcast(hot), key)
    rest = marked.where("__hot is null").drop("__hot").hint("merge").join(held.where(~is_hot), key)
    return found.unionByName(rest)
