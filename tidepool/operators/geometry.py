"""Joins in space: contacts, units and templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import PIECE, met

SLICES = 8  # of a cell's units


def _cells(df: DataFrame, radius: float, spread: bool) -> DataFrame:
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    if not spread:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    near = lambda c: F.array(c - 1, c, c + 1)
    return df.withColumn("_cx", F.explode(near(cx))).withColumn("_cy", F.explode(near(cy)))


def within(left: DataFrame, right: DataFrame, radius: float, same: list[str] = ()) -> DataFrame:
    """Pairs at most ``radius`` apart with equal ``same`` columns: a grid join with cells of that size.

    Both sides have (id, x, y); the result has (left, right, distance).
    """
    a = _cells(left, radius, True).withColumnRenamed("id", "left").withColumnRenamed("x", "ax").withColumnRenamed("y", "ay")
    b = _cells(right, radius, False).withColumnRenamed("id", "right").withColumnRenamed("x", "bx").withColumnRenamed("y", "by")
    met = a.join(b, ["_cx", "_cy", *same])
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return met.withColumn("distance", d).where(F.col("distance") <= radius).select("left", "right", *same, "distance")


def neighbours(channels: DataFrame, radius: float) -> DataFrame:
    at = channels.select(F.col("channel_index").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return within(at, at, radius).select(F.col("left").alias("channel"), F.col("right").alias("neighbour"), "distance")


def channel_map(channels: DataFrame, radius: float, most: int, group: str = "shank") -> DataFrame:
    """Per contact the nearest of its group, itself first, then by distance and id; at most ``most``."""
    at = channels.select(F.col("channel_index").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), group)
    order = Window.partitionBy("left").orderBy("distance", "right")
    pairs = within(at, at, radius, [group]).withColumn("slot", F.row_number().over(order) - 1)
    return pairs.where(F.col("slot") < most).select(F.col("left").alias("channel"), "slot", F.col("right").alias("contact"))


def guarded(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """Fail, rather than cut, where a key has more than ``most`` partners."""
    n = F.count("*").over(Window.partitionBy(key))
    return pairs.withColumn("_n", F.when(n <= most, n).otherwise(F.raise_error(F.lit(f"over {most} neighbours")).cast("long"))).where("_n > 0").drop("_n")


def spatial_pairs(left: DataFrame, right: DataFrame, radius: float, most: int = 256, bare: bool = False) -> DataFrame:
    """(left, right, probe, distance), ``bare`` the first two: units of one probe at most ``radius`` apart; over ``most`` for one of the left is an error.

    A cell's units meet all units of the nine cells around it in one place, a piece of the pairs at a time, so pairs are neither sorted nor exchanged.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(SLICES))
    a = _cells(left.select("probe", "id", "x", "y"), radius, False).withColumn("_part", part)
    b = _cells(right.select("probe", "id", "x", "y"), radius, True).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    kind = {c: left.schema[c].dataType.simpleString() for c in ("id", "probe")} | {"right": right.schema["id"].dataType.simpleString()}

    def run(key: tuple, p: pa.StructArray, q: pa.StructArray) -> Iterator[pa.RecordBatch]:
        (ax, ay), (bx, by) = ([np.asarray(s.field(c).cast(pa.float64())) for c in "xy"] for s in (p, q))
        step = max(1, PIECE // len(q))
        for n in range(0, len(p), step):
            d2 = (ax[n : n + step, None] - bx) ** 2 + (ay[n : n + step, None] - by) ** 2
            near = d2 <= radius * radius
            if near.sum(axis=1).max() > most:
                raise ValueError(f"over {most} neighbours")
            i, j = np.nonzero(near)
            pairs = {"left": p.field("id").take(pa.array(i + n)), "right": q.field("id").take(pa.array(j))}
            yield pa.RecordBatch.from_pydict(pairs if bare else pairs | {"probe": pa.repeat(key[0], len(i)), "distance": pa.array(np.sqrt(d2[i, j]))})

    return met(a, b, ["probe", "_cx", "_cy", "_part"], run, f"left {kind['id']}, right {kind['right']}" + ("" if bare else f", probe {kind['probe']}, distance double"))


def template_candidates(events: DataFrame, contacts: DataFrame, templates: DataFrame, most: int = 512) -> DataFrame:
    """Templates anchored on a contact near the event's channel, once each."""
    met = events.join(F.broadcast(contacts), events["channel_index"] == contacts["channel"]).join(templates, F.col("contact") == F.col("anchor")).select("row_id", "unit").distinct()
    return guarded(met, "row_id", most)
