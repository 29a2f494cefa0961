"""Interleaved int16 recordings as a Spark data source, in cores with overlapping halos.

A recording is one file, or the segments of a probe in a session manifest, on
one clock. Cores step inside each segment and never cross a file or a gap; a
halo is only cut by its segment's ends. A task reads its cores in one range of
bytes and hands on a batch of rows per core.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS = 3


@dataclass
class Cores(InputPartition):
    """[start, stop) is owned, in cores of ``step``; the segment is [first, last). Samples count on the source's clock."""

    path: str
    segment: int
    day: str | None
    first: int
    last: int
    start: int
    stop: int
    step: int
    halo: int


def plan(segments: list[tuple[str, int, int, str | None]], step: int, halo: int, start: int = 0, stop: int | None = None, grouped: int = 1) -> list[Cores]:
    """segments: (path, first, last, day). One entry per ``grouped`` cores of a segment, within [start, stop)."""
    if step < 1 or halo < 0 or grouped < 1 or start < 0 or (stop is not None and stop <= start):
        raise ValueError("cores need a positive step, a halo, and bounds in order")
    out = []
    for i, (path, first, last, day) in enumerate(segments):
        a, b = max(first, start), last if stop is None else min(last, stop)
        out += [Cores(path, i, day, first, last, x, min(x + step * grouped, b), step, halo) for x in range(a, b, step * grouped)]
    return out


def opened(path: str):
    """A file of any store that Arrow knows, and its size."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name), store.get_file_info(name).size


def read_frames(path: str, channels: int, first: int, n: int):
    """n frames from frame ``first`` on; a short read is tried again, then an error."""
    import numpy as np

    for attempt in range(ATTEMPTS):
        try:
            with opened(path)[0] as f:
                f.seek(first * channels * 2)
                data = f.read(n * channels * 2)
            if len(data) == n * channels * 2:
                return np.frombuffer(data, "<i2").reshape(n, channels)
            problem = OSError("short read")
        except OSError as e:
            problem = e
        if attempt < ATTEMPTS - 1:
            time.sleep(min(1.0, 0.2 * 2**attempt))
    raise problem


class Int16Source(DataSource):
    """format("int16").option("path" | "manifest" and "probe", "channels", "core", "halo", "gain", "grouped", "start", "stop")

    One row per frame: (core, t, owned, uv, segment, day), uv the channels'
    values in microvolts. A file without whole frames is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "int16"

    def schema(self) -> str:
        return "core long, t long, owned boolean, uv array<double>, segment int, day string"

    def reader(self, schema) -> DataSourceReader:
        return Int16Reader(self.options)


class Int16Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.step, self.halo, self.grouped = int(options.get("core", 60000)), int(options.get("halo", 2000)), int(options.get("grouped", 1))
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        if "manifest" in options:
            with opened(options["manifest"])[0] as f:
                session = json.loads(f.read())
            probe = next(p for p in session["probes"] if p["probe_id"] == options["probe"])
            folder = options["manifest"].rsplit("/", 1)[0]
            self.channels, self.gain = len(probe["geometry"]["x_um"]), float(options.get("gain", probe["gain_uv_per_count"]))
            self.segments = [(f"{folder}/{s['path']}", s["start_sample"], s["start_sample"] + s["n_samples"], s.get("day_id")) for s in probe["segments"]]
        else:
            self.channels, self.gain = int(options["channels"]), float(options.get("gain", 1.0))
            self.segments = [(options["path"], 0, -1, None)]

    def partitions(self) -> list[Cores]:
        frame, known = 2 * self.channels, []
        for path, first, last, day in self.segments:
            f, size = opened(path)
            f.close()
            if size % frame or (last >= 0 and size != (last - first) * frame):
                raise ValueError("the file does not hold whole frames, or as many as declared")
            known.append((path, first, first + size // frame, day))
        return plan(known, self.step, self.halo, self.start, self.stop, self.grouped)

    def read(self, part: Cores) -> Iterator:
        import numpy as np
        import pyarrow as pa

        low, high = max(part.first, part.start - part.halo), min(part.last, part.stop + part.halo)
        uv = read_frames(part.path, self.channels, low - part.first, high - low).astype(float) * self.gain
        for core in range(part.start, part.stop, part.step):
            end = min(core + part.step, part.stop)
            a, b = max(low, core - part.halo), min(high, end + part.halo)
            t, n = np.arange(a, b), b - a
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.channels), pa.array(uv[a - low : b - low].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, core)), pa.array(t), pa.array((t >= core) & (t < end)), lists, pa.array(np.full(n, part.segment, np.int32)), pa.array([part.day] * n, pa.string())], names=["core", "t", "owned", "uv", "segment", "day"])
