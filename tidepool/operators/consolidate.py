"""Grouping of nearby detections, in the order of the ledger."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PENDING = 4096
ISLANDS = 2000


def group_island(rows: pd.DataFrame, radius: int, patches: dict[int, set[int]], most: int = MOST_PENDING) -> list[dict]:
    """One island of rows (row_id, sample_index, channel_index, amplitude_uv, snr) in order of (sample, channel).

    A row joins the open group of its sign that sees its channel, or is seen by
    it, with the nearest anchor, then the higher SNR, then the earlier opening. A
    strictly higher SNR moves the anchor. Groups close once a row is more than
    ``radius`` after their first.
    """
    return _grouped(_records(rows), radius, patches, most)


def _records(rows: pd.DataFrame) -> list[tuple]:
    return list(zip(*(rows[c].tolist() for c in ("row_id", "sample_index", "channel_index", "amplitude_uv", "snr")), strict=True))


def _grouped(records: list[tuple], radius: int, patches: dict[int, set[int]], most: int = MOST_PENDING) -> list[dict]:
    open_, done = [], []
    for row_id, t, c, amplitude, snr in records:
        negative = amplitude < 0
        closed = [g for g in open_ if t - g["first"] > radius]
        done += closed
        open_ = [g for g in open_ if t - g["first"] <= radius]
        fit = [g for g in open_ if g["negative"] == negative and (c in patches[g["channel"]] or g["channel"] in patches[c])]
        if fit:
            g = min(fit, key=lambda g: (abs(t - g["anchor"]), -g["snr"], g["opened"]))
            g["members"].append(row_id)
            if snr > g["snr"]:
                g.update(anchor=t, channel=c, snr=snr)
        else:
            if len(open_) >= most:
                raise ValueError(f"over {most} pending groups")
            open_.append({"first": t, "anchor": t, "channel": c, "snr": snr, "negative": negative, "opened": len(done) + len(open_), "members": [row_id]})
    return sorted(done + open_, key=lambda g: (g["first"], g["opened"]))


def islands(ledger: DataFrame, radius: int, block: int = 86400) -> DataFrame:
    """Rows with the island they belong to: a gap of more than ``radius`` closes every group.

    Gaps are found within blocks of time, and across them from the last row of the block before.
    """
    order = Window.partitionBy("_b").orderBy("sample_index", "channel_index", "row_id")
    rows = ledger.withColumn("_b", F.floor(F.col("sample_index") / block)).withColumn("_p", F.lag("sample_index").over(order))
    last = rows.groupBy("_b").agg(F.max("sample_index").alias("_last"))
    before = F.broadcast(last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_before")))  # a row per block
    rows = rows.join(before, "_b").withColumn("_p", F.coalesce("_p", "_before"))
    starts = F.coalesce((F.col("sample_index") - F.col("_p") > radius).cast("int"), F.lit(1))
    rows = rows.withColumn("_s", starts).withColumn("_in", F.sum("_s").over(order))
    sums = rows.groupBy("_b").agg(F.sum("_s").alias("_n"))
    base = F.broadcast(sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base")))
    return rows.join(base, "_b").withColumn("island", F.col("_base") + F.col("_in")).drop("_b", "_p", "_before", "_s", "_in", "_base")


def consolidate(ledger: DataFrame, patches: dict[int, set[int]], radius: int) -> DataFrame:
    """(first_sample, anchor_sample, channel_index, snr, n, members) of every group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["island", "sample_index", "channel_index", "row_id"])
        cuts = np.flatnonzero(np.diff(rows["island"].to_numpy(), prepend=-1, append=-1))
        records = _records(rows)
        g = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in _grouped(records[a:b], radius, patches)]
        return pd.DataFrame({"first_sample": [x["first"] for x in g], "anchor_sample": [x["anchor"] for x in g], "channel_index": [x["channel"] for x in g], "snr": [x["snr"] for x in g], "n": [len(x["members"]) for x in g], "members": [x["members"] for x in g]})

    marked = islands(ledger.select("row_id", "sample_index", "channel_index", "amplitude_uv", "snr"), radius)
    # islands are small and many, so a task takes many at a time
    schema = "first_sample long, anchor_sample long, channel_index long, snr double, n long, members array<long>"
    return marked.withColumn("_chunk", F.floor(F.col("island") / ISLANDS)).groupBy("_chunk").applyInPandas(run, schema)


def epochs(events: DataFrame, bin_samples: int) -> DataFrame:
    """Batches of events by time bin."""
    return events.groupBy(F.floor(F.col("sample_index") / bin_samples).alias("epoch")).agg(F.count("*").alias("events"), F.min("sample_index").alias("first_sample"), F.max("sample_index").alias("last_sample"))


def rolling_bins(events: DataFrame, bin_samples: int, window: int, most: float = 100.0) -> DataFrame:
    """Per unit and bin the trailing mean over ``window`` bins, each bin's weight capped."""
    bins = events.groupBy("label", F.floor(F.col("t") / bin_samples).alias("bin")).agg(F.count("*").alias("n"), (F.sum(F.col("v").cast("decimal(38,6)")).cast("double") / F.count("*")).alias("mean")).withColumn("w", F.least(F.col("n").cast("double"), F.lit(most)))
    span = Window.partitionBy("label").orderBy("bin").rangeBetween(-(window - 1), 0)
    return bins.select("label", "bin", "n", (F.sum(F.col("w") * F.col("mean")).over(span) / F.sum("w").over(span)).alias("rolling"))
