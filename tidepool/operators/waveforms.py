"""Waveforms around events: layout, extraction from haloed blocks, encoding and decoding.

A waveform is one flat array, sample by sample, ``width`` channels each: the
anchor's local channels, the anchor first, missing ones -1 at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WaveformSpec:
    channel_index: tuple[tuple[int, ...], ...]
    pre: int
    post: int
    scale_uv: float = 0.05

    def __post_init__(self) -> None:
        n = len(self.channel_index)
        if not n or len({len(r) for r in self.channel_index}) != 1 or self.pre < 0 or self.post < 0 or not 0 < self.scale_uv < float("inf"):
            raise ValueError("a channel map, a window and a positive scale are needed")
        for c, row in enumerate(self.channel_index):
            real = [x for x in row if x >= 0]
            if row[0] != c or any(not -1 <= x < n for x in row) or len(set(real)) != len(real) or list(row[: len(real)]) != real:
                raise ValueError("the anchor comes first, channels are known and unique, missing ones pad the end")

    @property
    def samples(self) -> int:
        return self.pre + 1 + self.post

    @property
    def width(self) -> int:
        return len(self.channel_index[0])

    def metadata(self) -> dict:
        return {"channel_index": [list(r) for r in self.channel_index], "pre": self.pre, "post": self.post, "scale_uv": self.scale_uv}

    @classmethod
    def from_metadata(cls, m: dict) -> "WaveformSpec":
        return cls(tuple(map(tuple, m["channel_index"])), m["pre"], m["post"], m["scale_uv"])

    def local(self, anchor: Column) -> Column:
        """The local channels of an anchor: a lookup in the map, which is as small as the probe."""
        return F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in self.channel_index]), (anchor + 1).cast("int"))


def valid_mask(valid_start: Column, valid_stop: Column, local: Column, samples: int) -> Column:
    """Flat booleans: within [valid_start, valid_stop) and on a channel that is there."""
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    return F.flatten(F.transform(at, lambda i: F.transform(local, lambda c: (i >= valid_start) & (i < valid_stop) & (c >= 0))))


def extracted(events: DataFrame, frames: DataFrame, spec: WaveformSpec, start: int, stop: int, step: int) -> DataFrame:
    """events (row_id, sample_index, channel_index) with (valid_start, valid_stop, values).

    frames: (t, uv) of the source, whose bounds alone may cut a waveform; a
    frame missing inside them is an error. Each block of ``step`` samples takes
    along the frames of its halo, so a waveform is cut from one array.
    """
    block = lambda c: F.floor(c / step)
    spread = frames.withColumn("_b", F.explode(F.sequence(block(F.col("t") - spec.post), block(F.col("t") + spec.pre))))
    held = spread.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("t", "uv"))).alias("_f"))
    t = F.col("sample_index")
    met = events.withColumn("_b", block(t)).join(held, "_b", "left")
    first, last = F.greatest(t - spec.pre, F.lit(start)), F.least(t + spec.post, F.lit(stop - 1))
    at = F.col("_f")[0]["t"]
    whole = (t >= start) & (t < stop) & (at <= first) & (F.size("_f") > last - at) & (F.element_at("_f", (last - at + 1).cast("int"))["t"] == last)
    met = met.withColumn("valid_start", (first - (t - spec.pre)).cast("int")).withColumn("valid_stop", (last + 1 - (t - spec.pre)).cast("int"))
    met = met.withColumn("_first", F.when(F.coalesce(whole, F.lit(False)), (first - at).cast("int")).otherwise(F.raise_error(F.lit("frames are missing around an event")).cast("int")))
    met = met.withColumn("_w", F.slice("_f", F.col("_first") + 1, F.col("valid_stop") - F.col("valid_start"))).withColumn("_local", spec.local(F.col("channel_index")))
    zeros = F.transform("_local", lambda c: F.lit(0.0))
    one = lambda f: F.transform("_local", lambda c: F.when(c >= 0, F.get(f["uv"], c)).otherwise(0.0))
    body = F.transform("_w", one)
    pad = lambda n: F.when(n > 0, F.array_repeat(zeros, n.cast("int"))).otherwise(F.array().cast("array<array<double>>"))
    values = F.flatten(F.concat(pad(F.col("valid_start")), body, pad(F.lit(spec.samples) - F.col("valid_stop"))))
    return met.withColumn("values", values).drop("_b", "_f", "_first", "_w", "_local")


def encoded(values: Column, scale: float, bits: int = 16) -> Column:
    """Half-even counts of 16 bits, as ledgers store them, or of 32; what is out of these is an error, never clipped."""
    q, edge = lambda x: F.rint(x / scale), float(2 ** (bits - 1))
    return F.transform(values, lambda x: F.when((q(x) >= -edge) & (q(x) < edge), q(x)).otherwise(F.raise_error(F.lit(f"waveform exceeds int{bits}: raise the scale")).cast("double")).cast("int"))


def decoded(counts: Column, valid_start: Column, valid_stop: Column, anchor: Column, spec: WaveformSpec) -> Column:
    """Microvolts, null outside what was recorded."""
    mask = valid_mask(valid_start, valid_stop, spec.local(anchor), spec.samples)
    return F.zip_with(counts, mask, lambda x, ok: F.when(ok, x * F.lit(spec.scale_uv)))


def anchored(events: DataFrame, spec: WaveformSpec) -> DataFrame:
    """Rows whose waveform doesn't hold the event's own amplitude in its centre, or whose bounds lose it: none in a sound cache."""
    centre = F.element_at("values", spec.pre * spec.width + 1)
    return events.where((centre != F.col("amplitude_uv")) | (F.col("valid_start") > spec.pre) | (F.col("valid_stop") <= spec.pre))
