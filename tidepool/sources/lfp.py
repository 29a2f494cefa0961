"""Export of a low-rate copy of an int16 recording, in parts that can be resumed."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..operators.signal import kaiser_taps
from .int16 import read_frames


def filtered(path: str, channels: int, samples: int, first: int, n: int, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Outputs first .. first + n of the rational resampling by up / down: output k is centred on input time k * down / up; beyond the file is silence."""
    half = len(taps) // 2
    low, high = -((half - first * down) // up), ((first + n - 1) * down + half) // up + 1
    a, b = max(low, 0), min(high, samples)
    frames = read_frames(path, channels, a, b - a).astype(float)
    out = np.empty((n, channels))
    for i in range(n):
        at = (first + i) * down  # on the clock that is ``up`` times the input's
        x0, x1 = max(-((half - at) // up), a), min((at + half) // up + 1, b)
        weights = taps[half + at - np.arange(x0, x1) * up]
        out[i] = up * weights @ frames[x0 - a : x1 - a]
    return out


def export_lfp(spark: SparkSession, path: str, out: str, channels: int, rate: int, out_rate: int = 1250, passband: float = 500.0, part: int = 8192, resume: bool = False) -> dict:
    """Writes ``out``/part-*.i16, whose bytes in order are the export, and returns what it put into ``out``/export.json.

    ``out`` is a shared folder. A part is complete once its own .json is there;
    with ``resume`` complete parts stay. Values beyond int16 are clipped and counted.
    """
    if not 0 < out_rate < rate:
        raise ValueError("the output rate must be below the rate")
    ratio = Fraction(out_rate, rate)
    up, down = ratio.numerator, ratio.denominator
    size, frame = os.path.getsize(path), 2 * channels
    if size % frame or not size:
        raise ValueError("the file does not hold whole frames")
    settings = {"source": os.path.basename(path), "source_bytes": size, "channels": channels, "rate": rate, "out_rate": out_rate, "passband": passband, "part": part}
    record = f"{out}/settings.json"
    if os.path.exists(record):
        with open(record) as f:
            if not resume or json.load(f) != settings:
                raise FileExistsError("the folder holds an export; resume only with its settings")
    os.makedirs(out, exist_ok=True)
    with open(record, "w") as f:
        json.dump(settings, f)
    samples, taps = size // frame, kaiser_taps(rate * up, out_rate, passband)
    outputs = -(-samples * up // down)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["id"]:
                name, n = f"{out}/part-{p:08d}", min(part, outputs - p * part)
                if not os.path.exists(name + ".json"):
                    y = np.rint(filtered(path, channels, samples, p * part, n, up, down, taps))
                    clipped = int(((y < -32768) | (y > 32767)).sum())
                    own = f".{os.getpid()}.partial"  # two attempts at one task never share a file
                    y.clip(-32768, 32767).astype("<i2").tofile(name + own)
                    os.replace(name + own, name + ".i16")
                    with open(name + own, "w") as f:
                        json.dump({"n": n, "clipped": clipped}, f)
                    os.replace(name + own, name + ".json")
                with open(name + ".json") as f:
                    done = json.load(f)
                yield pd.DataFrame({"n": [done["n"]], "clipped": [done["clipped"]]})

    parts = -(-outputs // part)
    total = spark.range(0, parts, 1, min(parts, 10_000)).mapInPandas(write, "n long, clipped long").selectExpr("sum(n) as n", "sum(clipped) as clipped").first()
    result = settings | {"outputs": total.n, "clipped": total.clipped, "parts": parts}
    with open(f"{out}/export.json.partial", "w") as f:
        json.dump(result, f)
    os.replace(f"{out}/export.json.partial", f"{out}/export.json")
    return result
