"""The event ledger: calibration, queries over it, blocks, validation and late fetch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.views import FLOOR, MAD


def robust_noise(values: DataFrame, key: str = "channel_index", value: str = "amplitude_uv") -> DataFrame:
    """Per channel max(MAD / 0.67448975, 0.01)."""
    centre = values.groupBy(key).agg(F.median(value).alias("_m"))
    off = values.join(F.broadcast(centre), key).select(key, F.abs(F.col(value) - F.col("_m")).alias("_d"))  # a row per channel
    return off.groupBy(key).agg(F.greatest(F.median("_d") / MAD, F.lit(FLOOR)).alias("noise_uv"))


def with_snr(ledger: DataFrame, noise: DataFrame) -> DataFrame:
    return ledger.join(F.broadcast(noise), "channel_index").withColumn("snr", F.abs("amplitude_uv") / F.col("noise_uv")).drop("noise_uv")


def query(ledger: DataFrame, snr: float, saved_floor: float = 0.0, time: tuple[int | None, int | None] = (None, None), channels: list[int] | None = None, known: set[int] | None = None, polarity: str = "both") -> DataFrame:
    """Strict SNR filter, half-open time filter, channel list (None: all, []: none) and sign of the amplitude."""
    if not math.isfinite(snr) or snr < saved_floor:
        raise ValueError("the threshold must be finite and not below the saved floor")
    start, stop = time
    if start is not None and stop is not None and stop < start:
        raise ValueError("the time range is reversed")
    if channels is not None and known is not None and not set(channels) <= known:
        raise ValueError("unknown channel")
    if polarity not in ("both", "neg", "pos"):
        raise ValueError("polarity is both, neg or pos")
    out = ledger.where(F.col("snr") > snr)
    if start is not None:
        out = out.where(F.col("sample_index") >= start)
    if stop is not None:
        out = out.where(F.col("sample_index") < stop)
    if channels is not None:
        out = out.where(F.col("channel_index").isin(channels)) if channels else out.where(F.lit(False))
    if polarity != "both":
        out = out.where(F.col("amplitude_uv") < 0 if polarity == "neg" else F.col("amplitude_uv") > 0)
    return out


def blocks(ledger: DataFrame, step: int) -> DataFrame:
    """The zone map: first and last sample and row of every block of ``step`` samples."""
    b = F.floor(F.col("sample_index") / step)
    return ledger.groupBy(b.alias("block_id")).agg(F.min("sample_index").alias("start_sample"), (F.max("sample_index") + 1).alias("stop_sample"), F.min("row_id").alias("row_start"), (F.max("row_id") + 1).alias("row_stop"))


def pruned(ledger: DataFrame, index: DataFrame, step: int, start: int, stop: int) -> DataFrame:
    """Rows in [start, stop), from the blocks that can hold some. The index is a row per block of time."""
    hit = index.where((F.col("start_sample") < stop) & (F.col("stop_sample") > start)).select(F.col("block_id").alias("_b"))
    return ledger.withColumn("block_id", F.floor(F.col("sample_index") / step)).join(hit, F.col("block_id") == F.col("_b"), "left_semi").where((F.col("sample_index") >= start) & (F.col("sample_index") < stop))


def validate(ledger: DataFrame, noise: DataFrame) -> DataFrame:
    """Counts of rows, doubled (sample, channel) pairs, and rows without calibrated noise."""
    pairs = ledger.groupBy("sample_index", "channel_index").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") - 1).alias("doubled"))
    lost = ledger.join(noise, "channel_index", "left_anti").agg(F.count("*").alias("uncalibrated"))
    return pairs.crossJoin(lost)  # one row each


def cut_waveforms(ledger: DataFrame, row_ids: DataFrame) -> DataFrame:
    return ledger.join(row_ids, "row_id", "left_semi")


def quantised(value: Column, scale: float) -> Column:
    """Half-even rounding to int16 steps; out of range is an error."""
    q = F.rint(value / scale)
    return F.when(F.abs(q) <= 32767, q).otherwise(F.raise_error(F.lit("value out of int16 range")).cast("double")).cast("int")


def events_from_index(df: DataFrame, channels: int, index: str, offset: int = 0) -> DataFrame:
    """Sample and channel of a flat index; samples count from ``offset``."""
    return df.withColumn("t", F.floor(F.col(index) / channels) + offset).withColumn("channel", F.pmod(F.col(index), F.lit(channels)))


def csr_offsets(lists: DataFrame, order: str, size: str) -> DataFrame:
    """Where each list begins in their concatenation; by block of ``order`` first, so no task holds all."""
    block = F.floor(F.col(order) / 10000)
    sums = lists.groupBy(block.alias("_b")).agg(F.sum(size).alias("_n"))
    base = sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    inner = Window.partitionBy("_b").orderBy(order)
    placed = lists.withColumn("_b", block).withColumn("_in", F.sum(size).over(inner) - F.col(size))
    return placed.join(base, "_b").withColumn("offset", F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def first_observation(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one ledger and not in the other, both ways, repeats counted."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
