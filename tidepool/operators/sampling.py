"""Deterministic samples: hashed priorities, strata and quotas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


def uniform(df: DataFrame, index: str, budget: int, seed: int) -> DataFrame:
    """The ``budget`` rows of least priority."""
    hashed = H.with_hash(df, "_h", lambda: H.unsigned_order(H.by_index(F.col(index), seed)))
    return hashed.orderBy("_h").limit(budget).drop("_h")


def bucket_left(x: Column, edges: list[float]) -> Column:
    """How many edges are below x; a value on an edge falls in the lower bucket."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))


def strata(df: DataFrame, time_step: int, edges: list[float]) -> DataFrame:
    amp = F.abs("amplitude_uv")
    return df.withColumn("stratum", (F.floor(F.col("sample_index") / time_step) * 2 + F.floor(F.col("channel_index") / 16)) * (len(edges) + 1) + bucket_left(amp, edges))


def allocate_quotas(counts: list[int], budget: int, least: int) -> list[int]:
    """Shares in proportion to the root of the counts, with a floor per stratum and its count as a cap.

    Fractions are given to the largest remainders, the lower index first.
    """
    n = np.asarray(counts, np.int64)
    budget = int(min(budget, n.sum()))
    quota = np.minimum(n, least)
    if quota.sum() > budget:  # no floor, then
        quota = np.zeros_like(n)
    while (left := budget - int(quota.sum())) > 0:
        room = n - quota
        weight = np.where(room > 0, np.sqrt(n), 0.0)
        share = weight / weight.sum() * left
        whole = np.minimum(np.floor(share).astype(np.int64), room)
        if whole.sum() == 0:
            for i in sorted(np.flatnonzero(room > 0), key=lambda i: (-(share[i] - math.floor(share[i])), i))[:left]:
                quota[i] += 1
        else:
            quota += whole
    return quota.tolist()


def stratified(df: DataFrame, index: str, quotas: DataFrame, seed: int) -> DataFrame:
    """In each stratum its quota of rows of least priority. quotas: (stratum, quota), a row per stratum."""
    hashed = H.with_hash(df, "_h", lambda: H.unsigned_order(H.by_index(F.col(index), seed)))
    order = Window.partitionBy("stratum").orderBy("_h")
    return hashed.withColumn("_r", F.row_number().over(order)).join(quotas, "stratum").where(F.col("_r") <= F.col("quota")).drop("_h", "_r", "quota")


def least_per_group(df: DataFrame, keys: list[str], make, most: int, ties: list[str] = ()) -> DataFrame:
    """Per group the ``most`` rows of least priority ``make()``, of equal ones those least by the columns ``ties``; without these, any."""
    hashed = H.with_hash(df, "_h", lambda: H.unsigned_order(make()))
    return hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *ties))).where(F.col("_r") <= most).drop("_r", "_h")


def reservoir(df: DataFrame, anchor: str, per_anchor: int, overall: int) -> DataFrame:
    """Least priorities per anchor, then least overall: the state of a reservoir that has seen all."""
    make = lambda: H.by_time_and_channel(F.col("sample_index"), F.col("channel_index"))
    kept = least_per_group(df, [anchor], make, per_anchor)
    hashed = H.with_hash(kept, "_h", lambda: H.unsigned_order(make()))
    return hashed.orderBy("_h").limit(overall).drop("_h")


def calibration_windows(probes: DataFrame, seconds: int = 60, spacing: int = 7200, least: int = 3) -> DataFrame:
    """(start, stop) per probe of (start, stop): evenly spaced windows, moved back at the end."""
    n = F.greatest(F.lit(least), F.ceil((F.col("stop") - F.col("start")) / spacing))
    made = probes.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.col("start") + F.floor((F.col("stop") - F.col("start")) * (2 * F.col("i") + 1) / (2 * F.col("n"))) - seconds // 2
    start = F.greatest(F.col("start"), F.least(at, F.col("stop") - seconds))
    return made.select("probe", start.alias("window_start"), F.least(start + seconds, F.col("stop")).alias("window_stop")).distinct()


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at the whole parts of evenly spaced places. ``order`` is a gapless index from 0."""
    n = df.agg((F.max(order) + 1).alias("_n"))
    places = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("_i"), "_n").select(F.floor(F.col("_i") * (F.col("_n") - 1) / (k - 1)).alias("_at")).distinct()
    return df.join(F.broadcast(places), F.col(order) == F.col("_at")).drop("_at")  # k rows


def waveform_cache(df: DataFrame, budget: int) -> DataFrame:
    """Half the budget for the highest SNR, the rest by least priority among what is left, per block."""
    high = Window.partitionBy("block_id").orderBy(F.desc("snr"), "row_id")
    first = df.withColumn("_r", F.row_number().over(high))
    rest = least_per_group(first.where(F.col("_r") > budget // 2), ["block_id"], lambda: H.by_product(F.col("sample_index"), F.col("channel_index")), budget - budget // 2)
    return first.where(F.col("_r") <= budget // 2).withColumn("why", F.lit("snr")).drop("_r").unionByName(rest.withColumn("why", F.lit("hash")).drop("_r"))


def quantile_edges(df: DataFrame, index: str, value: str, rows: int = 100_000) -> DataFrame:
    """Median and ninth decile of every k-th row, k such that about ``rows`` are left. ``index`` is gapless from 0."""
    n = df.agg(F.count("*")).first()[0]
    some = df.where(F.pmod(F.col(index), F.lit(max(1, n // rows))) == 0)
    return some.agg(F.percentile(value, 0.5).alias("q50"), F.percentile(value, 0.9).alias("q90"))


def window_evidence(df: DataFrame, unit: str, window: str, sample: str, most: int) -> DataFrame:
    """Per (unit, window) the ``most`` samples of least priority, each sample once; the same whatever order rows come in."""
    once = df.withColumn("_one", F.row_number().over(Window.partitionBy(unit, window, sample).orderBy(*[c for c in df.columns if c not in (unit, window, sample)]))).where("_one = 1").drop("_one")
    return least_per_group(once, [unit, window], lambda: H.by_time(F.col(sample)), most)


def stratum_ids(df: DataFrame, centres: list[float], time_step: int, depth_min: float, depth_bins: int, depth_bin: float, edges: list[float]) -> DataFrame:
    """((time * shank) * depth) * amplitude strata of rows (t, x, depth, size): nearest shank centre, depth bins with the deepest in the last."""
    x = F.col("x")
    near = F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]
    depth = F.least(F.greatest(F.floor((F.col("depth") - depth_min) / depth_bin), F.lit(0)), F.lit(depth_bins - 1))
    return df.withColumn("stratum", ((F.floor(F.col("t") / time_step) * len(centres) + near) * depth_bins + depth) * (len(edges) + 1) + bucket_left(F.col("size"), edges))


def sample_ledger(events: DataFrame, channels: DataFrame, budget: int, seed: int, start: int, stop: int, time_bins: int = 30, depth_bin: float = 80.0, least: int = 4) -> tuple[DataFrame, DataFrame, dict]:
    """A stratified sample (row_id, stratum, weight), a uniform one (row_id), and a report of a whole ledger.

    events: (row_id, sample_index, channel_index, snr); channels: (channel_index,
    x, y, shank). Weights are the inverse chances of inclusion. The table of
    strata and quotas is small; the rows are not collected.
    """
    geometry = channels.agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), (F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    depth = "y" if (geometry.ny, geometry.sy) > (geometry.nx, geometry.sx) else "x"
    side = "x" if depth == "y" else "y"
    low, high = (geometry.y0, geometry.y1) if depth == "y" else (geometry.x0, geometry.x1)
    centres = [r.c for r in channels.groupBy("shank").agg(F.avg(side).alias("c")).orderBy("shank").collect()]  # a row per shank
    told = quantile_edges(events, "row_id", "snr").first()
    edges = [told.q50, told.q90]
    bins = max(1, math.ceil((high - low) / depth_bin))
    placed = events.join(F.broadcast(channels), "channel_index").select("row_id", (F.col("sample_index") - start).alias("t"), F.col(side).cast("double").alias("x"), F.col(depth).cast("double").alias("depth"), F.col("snr").alias("size"))
    strata_ = stratum_ids(placed, centres, max(1, math.ceil((stop - start) / time_bins)), float(low), bins, depth_bin, edges).select("row_id", "stratum")
    counts = strata_.groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()  # a row per stratum
    quotas = allocate_quotas([r.n for r in counts], budget, least) if counts else []
    table = df_of(events, [(r.stratum, q, r.n / q) for r, q in zip(counts, quotas, strict=True) if q])
    chosen = stratified(strata_, "row_id", table.select("stratum", "quota"), seed).join(table.select("stratum", "weight"), "stratum")
    report = {"rows": sum(r.n for r in counts), "selected": sum(quotas), "strata": len(counts), "selected_strata": sum(q > 0 for q in quotas), "depth_axis": depth, "edges": edges, "seed": seed, "budget": budget}
    return chosen.select("row_id", "stratum", "weight"), uniform(events, "row_id", budget, seed).select("row_id"), report


def df_of(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "stratum long, quota long, weight double")
