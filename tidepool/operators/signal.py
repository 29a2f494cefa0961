"""Windows over dense signals: referencing, detectors, quality flags; and filters over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_median(grid: DataFrame, least: int = 2) -> DataFrame:
    """At each time the median over channels is taken off, if there are enough."""
    at = Window.partitionBy("t")
    enough = F.count("*").over(at) >= least
    return grid.withColumn("r", F.col("v") - F.when(enough, F.median("v").over(at)).otherwise(0.0))


#: Samples of a core where nothing else is asked for: what looks along time does so within (core, channel).
CORE = 60_000


def haloed(rows: DataFrame, core: int, halo: int) -> DataFrame:
    """Rows with ``core``, once for every core whose halo they are in, and ``owned`` for the one they belong to."""
    at = lambda t: F.floor(t / core)
    spread = rows.withColumn("core", F.explode(F.sequence(at(F.col("t") - halo), at(F.col("t") + halo))))
    return spread.withColumn("owned", at(F.col("t")) == F.col("core"))


def local_maxima(grid: DataFrame, radius: int, floor: float, core: int = CORE) -> DataFrame:
    """Above the floor, above the ``radius`` samples before, not below those after; missing ones don't matter. By core, with a halo of the radius."""
    order = Window.partitionBy("core", "channel").orderBy("t")
    before, after = F.max("v").over(order.rowsBetween(-radius, -1)), F.max("v").over(order.rowsBetween(1, radius))
    marked = haloed(grid, core, radius).withColumn("_p", before).withColumn("_n", after)
    return marked.where(F.col("owned") & (F.col("v") > floor) & (F.col("_p").isNull() | (F.col("v") > F.col("_p"))) & (F.col("_n").isNull() | (F.col("v") >= F.col("_n")))).drop("_p", "_n", "core", "owned")


def smooth3(grid: DataFrame, core: int = CORE) -> DataFrame:
    """[1, 2, 1] / 4 over time; ends stay as they are. By core, with a halo of one sample."""
    order = Window.partitionBy("core", "channel").orderBy("t")
    a, b = F.lag("v").over(order), F.lead("v").over(order)
    smooth = haloed(grid, core, 1).withColumn("s", F.when(a.isNull() | b.isNull(), F.col("v")).otherwise((a + 2 * F.col("v") + b) * 0.25))
    return smooth.where("owned").select("t", "channel", F.col("s").alias("v"))


def spatial_suppression(peaks: DataFrame, neighbours: DataFrame, radius: int) -> DataFrame:
    """Peaks with no higher one on a neighbouring channel within 2 * radius samples; ties stay.

    A range join by buckets of time: every peak looks into three buckets.
    """
    width = 2 * radius + 1
    bucket = F.floor(F.col("t") / width)
    right = peaks.select(F.col("t").alias("t2"), F.col("channel").alias("c2"), F.col("v").alias("v2"), bucket.alias("b2"))
    left = peaks.withColumn("b2", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    pairs = left.join(F.broadcast(neighbours), "channel").withColumnRenamed("neighbour", "c2").join(right, ["b2", "c2"]).where(F.abs(F.col("t") - F.col("t2")) <= 2 * radius)
    return pairs.groupBy("t", "channel", "v").agg(F.max("v2").alias("m")).where(F.col("v") >= F.col("m") - 1e-8).drop("m")


def channel_flags(grid: DataFrame, saturated: float, flat: float = 0.98, zero: float = 0.99, core: int = CORE) -> DataFrame:
    order = Window.partitionBy("core", "channel").orderBy("t")
    still = (F.col("v") == F.lag("v").over(order)).cast("double")
    rows = haloed(grid, core, 1).withColumn("_flat", still).where("owned")
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy("channel").agg(F.round(share(F.col("v") >= saturated), 6).alias("saturated"), F.round(F.avg("_flat"), 6).alias("flat"), F.round(share(F.col("v") == 0), 6).alias("zero"))
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return out.withColumn("flags", (bit(F.col("saturated") > 1e-4, 1).bitwiseOR(bit(F.col("flat") > flat, 2)).bitwiseOR(bit(F.col("zero") > zero, 4))).cast("long"))


def bad_intervals(ledger: DataFrame, step: int, share: float) -> DataFrame:
    """Blocks in which errors are more than a share of rows."""
    bad = F.avg((F.col("event_type") == "error").cast("double"))
    return ledger.groupBy(F.floor(F.col("sample_index") / step).alias("block_id")).agg(F.count("*").alias("n"), (bad > share).alias("interval_bad"))


def decimate(grid: DataFrame, taps: list[int], factor: int) -> DataFrame:
    """Every ``factor``-th sample of the signal under a symmetric FIR of integer taps over their sum.

    Each input row adds to the few outputs whose support holds it, so there's no window over a whole channel.
    """
    half, total = len(taps) // 2, float(sum(taps))
    weights = F.array(*[F.lit(float(w)) for w in taps])
    first = F.ceil((F.col("t") - half) / factor)
    last = F.floor((F.col("t") + half) / factor)
    spread = grid.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last))))
    tap = F.element_at(weights, (F.col("t") - F.col("k") * factor + half + 1).cast("int"))
    return spread.groupBy("channel", "k").agg(F.round(F.sum((F.col("v") * tap).cast("decimal(38,6)")).cast("double") / total, 6).alias("y"))


def kaiser_taps(rate: float, out_rate: float, passband: float, attenuation: float = 60.0) -> np.ndarray:
    """Anti-alias low pass: a windowed sinc between passband and the output's Nyquist rate."""
    width = (out_rate / 2 - passband) / (rate / 2)
    n = int(np.ceil((attenuation - 7.95) / (2.285 * np.pi * width) + 1)) | 1
    if not 0 < width or n > 100_001:
        raise ValueError("the transition band is too narrow")
    beta = 0.1102 * (attenuation - 8.7)
    cutoff = (passband + out_rate / 2) / rate
    m = np.arange(n) - (n - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.kaiser(n, beta)
    return h / h.sum()


def butterworth_band(rate: float, low: float, high: float, order: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth band pass, by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    w1, w2 = warp(low), warp(high)
    band, centre = w2 - w1, np.sqrt(w1 * w2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    p = poles * band / 2
    analog = np.concatenate([p + np.sqrt(p**2 - centre**2 + 0j), p - np.sqrt(p**2 - centre**2 + 0j)])
    digital = (2 * rate + analog) / (2 * rate - analog)
    upper = sorted((z for z in digital if z.imag > 1e-12), key=lambda z: z.imag)
    real = sorted(z.real for z in digital if abs(z.imag) <= 1e-12)
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * z.real, abs(z) ** 2])) for z in upper]
    sections += [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -(a + b), a * b])) for a, b in zip(real[::2], real[1::2], strict=True)]
    middle = np.exp(2j * np.pi * np.sqrt(low * high) / rate)
    gain = np.prod([np.polyval(b, middle) / np.polyval(a, middle) for b, a in sections])
    sections[0] = (sections[0][0] / abs(gain), sections[0][1])
    return sections


def _run(section: tuple[np.ndarray, np.ndarray], x: np.ndarray, block: int = 64) -> np.ndarray:
    """One section over axis 0, a block of samples at a time: what a block and the state before it give is linear in both."""
    b, a = section
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(powers[-1] @ step)
    impulse = np.array([b[0], *[(powers[i] @ into)[0] for i in range(block - 1)]])
    lag = np.arange(block)[:, None] - np.arange(block)
    own = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    from_state = np.stack([p[0] for p in powers[:block]])
    to_state = np.stack([powers[block - 1 - i] @ into for i in range(block)], axis=1)
    n = len(x)
    padded = np.concatenate([x, np.zeros((-n % block, *x.shape[1:]))]).reshape(-1, block, *x.shape[1:])
    y, state = np.empty_like(padded), np.zeros((2, *x.shape[1:]))
    for i, part in enumerate(padded):
        y[i] = own @ part + from_state @ state
        state = powers[block] @ state + to_state @ part
    return y.reshape(-1, *x.shape[1:])[:n]


def zero_phase(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward over time (axis 0), with odd reflection at both ends."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1) * 8)
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]]).astype(float)
    for _ in range(2):
        for s in sections:
            ext = _run(s, ext)
        ext = ext[::-1]
    return ext[pad : len(ext) - pad]
