"""Exact duplicates through a persistent digest index (operator 5).

The index is a table bucketed and sorted by digest, with the document that stays
of every distinct text ever seen and how many carried it. New rows are reduced
to one per digest and written, then joined against the index by a sort-merge
anti-join that moves no index row, and what is new is appended. Digests that the
index has get a row with their further count and no document; a reader adds the
counts up within the buckets, without a shuffle.

Only built-in DataFrame functions run here. Texts are read once, to write
(id, digest); everything later moves 40 bytes a row. The reduction comes before
the join and is written in between: left to itself, the optimiser would move the
join below it, and all copies of a hot digest into one task.

Edge cases: a null text equals the empty text, and texts of any length are hashed
whole; a null id is the smallest; of equal texts the largest id stays, and rows
with that id and text, however often they are repeated, are all kept, as they are
the same document; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, text_of, written

#: A digest is hot if it holds over 1/HOT_SHARE of all rows, so at most HOT_SHARE digests are.
HOT_SHARE = 1024


def digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest) of every row; the digest is 32 bytes of SHA-256 of the text in UTF-8."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_column).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """Open (or begin) the index in ``path``; it keeps the number of buckets that it began with.

    ``close`` takes its name out of the catalog, and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        try:
            self.buckets = spark.read.parquet(f"{path}-buckets").first()[0]
        except AnalysisException:  # no such index yet
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(self.buckets, self.buckets + 1).withColumnRenamed("id", "buckets").write.parquet(f"{path}-buckets")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size), a row per digest."""
        return self.spark.read.table(self.name).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, rows: DataFrame) -> int:
        """rows: (doc_id, digest). Append digests not in the index, and further counts of those that are; returns how many are new.

        Counts are combined before the shuffle, so copies cost one row per task.
        """
        new = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        held = self.spark.read.table(self.name)
        fresh = new.hint("merge").join(held.select("digest"), "digest", "left_anti")
        if held.isEmpty():
            self._append(fresh)
            return new.count()
        known = written(new.hint("merge").join(held.select("digest"), "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("long")), "digests-known")
        before = known.count()
        self._append(written(fresh.unionByName(known), "digest-batch"))
        return new.count() - before

    def _append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "group_size").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def against_index(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """What the index says of every row of (doc_id, digest).

    Hot digests are few by definition, so they are broadcast; the rest is joined
    by digest with the index's own buckets, no key of which is large.
    """
    held = index.read()
    total = held.agg(F.sum("group_size")).first()[0] or 0
    hot = held.where(F.col("group_size") * HOT_SHARE > F.lit(total)).select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), F.col("group_size").alias("n"))
    marked = rows.join(F.broadcast(hot), rows["digest"] == hot["d"], "left")
    found = marked.where("d is not null").select("doc_id", "digest", F.col("k").alias("keep_id"), F.col("n").alias("group_size"))
    rest = marked.where("d is null").select("doc_id", "digest").hint("merge").join(held, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return found.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(df: DataFrame, index_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add a table to the index (a new one by default) and say of each row which row stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256). Of equal texts that
    come together the row with the largest id stays; texts that were in the
    index before keep the row they had, so none of the new rows is kept.
    """
    spark = df.sparkSession
    rows = written(digests(df, id_column, text_column), "digests")
    index = DigestIndex(spark, index_path or scratch(spark, "digest-index"))
    index.add(rows)
    found = against_index(rows, index)
    index.close()  # the result has been bound to the files
    return found
