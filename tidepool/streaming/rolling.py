"""Rolling templates and consolidated events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def split_late(batch: DataFrame, through: int) -> tuple[DataFrame, DataFrame]:
    """Rows on time and late ones; late rows are kept apart, not dropped."""
    return batch.where(F.col("t") >= through), batch.where(F.col("t") < through)


def rolling_templates(stream: DataFrame, folder: str, bin_samples: int) -> StreamingQuery:
    """Bins of (label, bin, n, total) by micro-batch below ``folder``/bins, late rows below ``folder``/late.

    A batch is written under its own id, so one that is run again replaces
    itself; state is the table, and the sample it has come through stands in
    each batch's folder.
    """
    spark = stream.sparkSession

    def commit(batch: DataFrame, number: int) -> None:
        through = -1
        if number:
            before = spark.read.parquet(f"{folder}/through").where(F.col("batch") < number)
            last = before.agg(F.max("through")).first()[0]
            through = -1 if last is None else last
        good, late = split_late(batch, through)
        sums = good.groupBy("label", F.floor(F.col("t") / bin_samples).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,6)")).alias("total"))
        sums.write.mode("overwrite").parquet(f"{folder}/bins/batch={number}")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        good.agg(F.coalesce(F.max("t"), F.lit(through)).cast("long").alias("through")).write.mode("overwrite").parquet(f"{folder}/through/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str, window: int, most: float = 100.0) -> DataFrame:
    """The rolling means that the committed batches give; equal to the batch operator on the same rows."""
    from pyspark.sql import Window

    bins = spark.read.parquet(f"{folder}/bins").groupBy("label", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = bins.withColumn("w", F.least(F.col("n").cast("double"), F.lit(most))).withColumn("mean", F.col("total").cast("double") / F.col("n"))
    span = Window.partitionBy("label").orderBy("bin").rangeBetween(-(window - 1), 0)
    return w.select("label", "bin", "n", (F.sum(F.col("w") * F.col("mean")).over(span) / F.sum("w").over(span)).alias("rolling"))

