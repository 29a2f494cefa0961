"""From raw counts to signals that detectors can use: calibration, reference, band pass, noise, quality and masks.

Long form throughout: (t, channel, v), one row per sample and channel. What looks
along time does so within (core, channel), halos included, never over a whole
channel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import MAD
from .signal import butterworth_band, haloed, zero_phase

SATURATED, FLAT, DROPOUT, NOISY, ARTIFACT, USER_BAD = 1, 2, 4, 8, 16, 32
FLOOR = 0.01


def calibrated(raw: DataFrame, calibration: DataFrame, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Counts to microvolts; calibration (channel, gain, offset) has a row per channel, missing ones take the defaults."""
    if not (math.isfinite(gain) and math.isfinite(offset)):
        raise ValueError("calibration must be finite")
    met = raw.join(F.broadcast(calibration), "channel", "left")  # a row per channel
    of = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    v = F.col("v") * of("gain", gain) + of("offset", offset)
    ok = ~(F.isnan(v) | (F.abs(v) == float("inf")))
    return met.select("t", "channel", F.when(ok, v).otherwise(F.raise_error(F.lit("calibration must be finite")).cast("double")).alias("v"))


def shank_reference(grid: DataFrame, channels: DataFrame, least: int = 2) -> DataFrame:
    """At each time the median of a shank's good channels is taken off all of the shank, where it has ``least`` good ones. channels: (channel, shank, bad)."""
    at = Window.partitionBy("t", "shank")
    good = F.when(~F.col("bad"), F.col("v"))
    centre = F.when(F.count(good).over(at) >= least, F.median(good).over(at)).otherwise(0.0)
    return grid.join(F.broadcast(channels.select("channel", "shank", "bad")), "channel").select("t", "channel", (F.col("v") - centre).alias("v"))  # a row per channel


def band_passed(grid: DataFrame, rate: float, core: int, halo: int, low: float = 300.0, high: float | None = None, order: int = 3) -> DataFrame:
    """Zero-phase Butterworth band pass by core and channel; a core's halo is only cut by the recording's ends."""
    high = min(6000.0, 0.4 * rate) if high is None else high
    if high <= low:
        raise ValueError("the sample rate is too low for the band")
    sections = butterworth_band(rate, low, high, order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        if len(rows) < 64:
            raise ValueError("too short for zero-phase filtering")
        y = zero_phase(sections, rows["v"].to_numpy()[:, None])[:, 0]
        keep = rows["owned"].to_numpy()
        return pd.DataFrame({"t": rows["t"].to_numpy()[keep], "channel": rows["channel"].to_numpy()[keep], "v": y[keep]})

    cores = haloed(grid, core, halo)
    # halos beyond the ends would be cores of their own that own nothing
    real = cores.groupBy("core").agg(F.max("owned").alias("_any")).where("_any").select("core")
    return cores.join(F.broadcast(real), "core").groupBy("core", "channel").applyInPandas(run, "t long, channel long, v double")  # a row per core


def strided_noise(grid: DataFrame, core: int, rows: int = 4000) -> DataFrame:
    """(core, channel, noise): max(MAD / 0.67448975, 0.01) over every k-th sample of a core, k such that about ``rows`` are left."""
    step = max(1, core // rows)
    some = grid.withColumn("core", F.floor(F.col("t") / core)).where(F.pmod(F.col("t") - F.col("core") * core, F.lit(step)) == 0)
    middle = some.groupBy("core", "channel").agg(F.median("v").alias("_m"))
    off = some.join(middle, ["core", "channel"]).withColumn("_d", F.abs(F.col("v") - F.col("_m")))
    return off.groupBy("core", "channel").agg(F.greatest(F.median("_d") / MAD, F.lit(FLOOR)).alias("noise"))


def assessed(raw: DataFrame, signal: DataFrame, channels: DataFrame, core: int, saturated: float = 32760.0, rows: int = 4000) -> DataFrame:
    """(core, channel, saturated, flat, zero, noise, flags, interval_bad) of every core and channel.

    raw: counts, signal: preprocessed microvolts, channels: (channel, shank, bad).
    An artifact is an instant at which over 30 % of 8 or more usable channels are
    above ten times their noise; it marks all channels. A core is bad if it has
    one, or if over 20 % of its channels aren't usable.
    """
    own = raw.withColumn("core", F.floor(F.col("t") / core))
    order = Window.partitionBy("core", "channel").orderBy("t")
    share = lambda c: F.avg(c.cast("double"))
    still = own.withColumn("_same", (F.col("v") == F.lag("v").over(order)).cast("double"))
    counts = still.groupBy("core", "channel").agg(share(F.abs("v") >= saturated).alias("saturated"), F.coalesce(F.avg("_same"), F.lit(1.0)).alias("flat"), share(F.col("v") == 0).alias("zero"))
    noise = strided_noise(signal, core, rows)
    told = counts.join(noise, ["core", "channel"]).join(F.broadcast(channels), "channel")  # a row per channel
    base = F.median("noise").over(Window.partitionBy("core", "shank"))
    bit = lambda c, b: F.when(c, b).otherwise(0)
    flags = bit(F.col("saturated") > 1e-4, SATURATED)
    for more in (bit(F.col("flat") > 0.98, FLAT), bit(F.col("zero") > 0.99, DROPOUT), bit(F.col("noise") > F.greatest(5 * base, F.lit(100.0)), NOISY), bit(F.col("bad"), USER_BAD)):
        flags = flags.bitwiseOR(more)
    told = told.withColumn("flags", flags)
    fine = told.where("flags = 0").select("core", "channel", "noise")
    loud = signal.withColumn("core", F.floor(F.col("t") / core)).join(fine, ["core", "channel"])
    instants = loud.groupBy("core", "t").agg(F.count("*").alias("_n"), share(F.abs("v") > 10 * F.col("noise")).alias("_loud"))
    artifacts = instants.groupBy("core").agg(F.max((F.col("_n") >= 8) & (F.col("_loud") > 0.3)).alias("artifact"))
    full = told.join(artifacts, "core", "left").withColumn("artifact", F.coalesce("artifact", F.lit(False)))
    bad = F.col("artifact") | (F.avg((F.col("flags") != 0).cast("double")).over(Window.partitionBy("core")) > 0.2)
    return full.select("core", "channel", "saturated", "flat", "zero", "noise", F.col("flags").bitwiseOR(bit(F.col("artifact"), ARTIFACT)).cast("long").alias("flags"), bad.alias("interval_bad"))


def usable(flags: Column) -> Column:
    """No flag but that of an artifact."""
    return flags.bitwiseAND(F.lit(0xFF & ~ARTIFACT)) == 0


def masked(signal: DataFrame, quality: DataFrame, core: int) -> DataFrame:
    """(t, channel, v, noise): channels that aren't usable are silent and infinitely noisy."""
    told = quality.select("core", "channel", "noise", usable(F.col("flags")).alias("_ok"))
    met = signal.withColumn("core", F.floor(F.col("t") / core)).join(told, ["core", "channel"])
    return met.select("t", "channel", F.when(F.col("_ok"), F.col("v")).otherwise(0.0).alias("v"), F.when(F.col("_ok"), F.col("noise")).otherwise(float("inf")).alias("noise"))


def without_artifacts(rows: DataFrame, quality: DataFrame, core: int) -> DataFrame:
    """Rows (t, ...) outside bad cores: those that may teach."""
    bad = quality.where("interval_bad").select("core").distinct()
    return rows.withColumn("core", F.floor(F.col("t") / core)).join(bad, "core", "left_anti").drop("core")


def check_detector(radius: int, floor: float, start: int, stop: int, samples: int) -> None:
    if not isinstance(radius, int) or radius < 1:
        raise ValueError("the radius must be a positive whole number")
    if not (math.isfinite(floor) and floor > 0):
        raise ValueError("the floor must be positive")
    if not 0 <= start < stop <= samples:
        raise ValueError("the valid span must be inside the samples")


def correlated(grid: DataFrame, kernels: list[list[float]], core: int) -> DataFrame:
    """(t, channel, kernel, v): each kernel's correlation with the samples around t, missing ones zero; by core and channel with a halo."""
    k = np.array(kernels, float)
    half = k.shape[1] // 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, keep = rows["t"].to_numpy(), rows["owned"].to_numpy()
        line = np.zeros(t[-1] - t[0] + 1 + 2 * half)
        line[t - t[0] + half] = rows["v"].to_numpy()
        windows = np.lib.stride_tricks.sliding_window_view(line, k.shape[1])[t[keep] - t[0]]
        y = windows @ k.T
        n = keep.sum()
        return pd.DataFrame({"t": np.repeat(t[keep], len(k)), "channel": np.repeat(rows["channel"].to_numpy()[keep], len(k)), "kernel": np.tile(np.arange(len(k)), n), "v": y.ravel()})

    return haloed(grid, core, half).groupBy("core", "channel").applyInPandas(run, "t long, channel long, kernel long, v double")


def template_scores(projections: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, filter, choice, score): weighted sums over a filter's channels. projections: (t, channel, kernel, v); weights: (filter, choice, channel, w)."""
    met = projections.join(F.broadcast(weights), "channel")  # the probe's filters
    return met.groupBy("t", "filter", (F.col("choice") * 1000 + F.col("kernel")).alias("choice")).agg(F.sum((F.col("w") * F.col("v")).cast("decimal(38,9)")).cast("double").alias("score"))


def signed_maxima(scores: DataFrame) -> DataFrame:
    """Per (t, filter) the score of the largest magnitude, the first choice on a tie."""
    best = F.max_by(F.struct("score", "choice"), F.struct(F.abs("score"), -F.col("choice")))
    return scores.groupBy("t", "filter").agg(best.alias("_b")).select("t", "filter", F.col("_b.score").alias("score"), F.col("_b.choice").alias("choice"))


def neighbour_maxima(values: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Per (t, filter) the largest score among the filter's neighbours. neighbours: (filter, neighbour)."""
    right = values.select("t", F.col("filter").alias("neighbour"), F.col("score").alias("_s"))
    return values.select("t", "filter").join(F.broadcast(neighbours), "filter").join(right, ["t", "neighbour"]).groupBy("t", "filter").agg(F.max("_s").alias("most"))


def learned_maxima(scores: DataFrame, norms: DataFrame, first: int, last: int, edge: int) -> DataFrame:
    """Per t the unit of the largest relu(b)^2 / norm, the first on a tie; within ``edge`` of the ends it is zero. scores: (t, unit, b); norms: (unit, norm)."""
    value = F.when(F.col("t").between(first + edge, last - edge), F.greatest(F.col("b"), F.lit(0.0)) ** 2 / F.col("norm")).otherwise(0.0)
    met = scores.join(F.broadcast(norms), "unit").withColumn("_v", value)
    best = F.max_by(F.struct("_v", "unit"), F.struct("_v", -F.col("unit")))
    return met.groupBy("t").agg(best.alias("_b")).select("t", F.col("_b._v").alias("best"), F.col("_b.unit").alias("unit"))


def subtracted(scores: DataFrame, events: DataFrame, correlations: DataFrame, radius: int) -> DataFrame:
    """scores (t, unit, b) less what events (t, unit, amplitude) explain by correlations (unit, other, lag, c); order doesn't matter, overlaps add up."""
    lags = events.select(F.col("t").alias("_t"), F.col("unit").alias("other"), "amplitude").join(F.broadcast(correlations), "other")
    if radius < 0:
        raise ValueError("the radius must not be negative")
    away = lags.where(F.abs("lag") <= radius).groupBy((F.col("_t") + F.col("lag")).alias("t"), "unit").agg(F.sum((F.col("amplitude") * F.col("c")).cast("decimal(38,9)")).cast("double").alias("_x"))
    return scores.join(away, ["t", "unit"], "left").select("t", "unit", (F.col("b") - F.coalesce("_x", F.lit(0.0))).alias("b"))


def projected(df: DataFrame, column: str, matrix: np.ndarray, out: str = "features") -> DataFrame:
    """An array column times a matrix, batch by batch; the matrix goes with the closure and is a bank's, not the data's."""
    m = np.asarray(matrix, float)

    @F.pandas_udf("array<double>")
    def times(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ m)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(out, times(column))
