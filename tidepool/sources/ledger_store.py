"""Event ledgers on disk: written whole, checked, opened, read by blocks of time, extended by waveforms.

A ledger is a folder: ``events`` partitioned by block of time, ``noise`` by
channel, ``waveforms`` (in an extended ledger) partitioned like the events, and
``manifest.json`` with the block index. It is written under another name and
renamed when complete; a published ledger never changes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import query as select_events
from ..operators.waveforms import WaveformSpec, decoded
from . import files

FORMAT, VERSIONS = "tidepool-ledger", ("1", "2")  # 2: with waveforms
EVENTS = "row_id long, sample_index long, channel_index long, amplitude_uv double, snr double"


def check_events(events: DataFrame, noise: DataFrame, floor: float, start: int, stop: int) -> None:
    """Every fault of a set of events is an error: bounds, channels, doubled places, numbers, floor, and SNR that isn't amplitude over noise."""
    told = events.join(F.broadcast(noise.select("channel_index", "noise_uv")), "channel_index", "left")  # a row per channel
    want = F.abs("amplitude_uv") / F.col("noise_uv")
    finite = lambda c: ~(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")))
    faults = {
        "event outside the recording": ~F.col("sample_index").between(start, stop - 1),
        "event on an unknown channel": F.col("noise_uv").isNull(),
        "numbers that are not finite": ~(finite("snr") & finite("amplitude_uv")),
        "event at or below the floor": F.col("snr") <= floor,
        "SNR differs from amplitude over noise": F.abs(F.col("snr") - want) > 1e-6 + 2e-6 * want,
    }
    counts = told.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(str(i)) for i, c in enumerate(faults.values())]).first()
    for name, n in zip(faults, counts, strict=True):
        if n:
            raise ValueError(f"{n} rows: {name}")
    if not events.groupBy("sample_index", "channel_index").count().where("count > 1").isEmpty():
        raise ValueError("events must be unique by sample and channel")


def numbered(events: DataFrame, step: int) -> DataFrame:
    """Adds block_id and row_id, gapless from 0 in order of (sample, channel); by block first, so no task holds all."""
    rows = events.withColumn("block_id", F.floor(F.col("sample_index") / step))
    sums = rows.groupBy("block_id").agg(F.count("*").alias("_n"))
    bases = sums.select("block_id", (F.sum("_n").over(Window.orderBy("block_id")) - F.col("_n")).alias("_base"))  # a row per block
    inner = Window.partitionBy("block_id").orderBy("sample_index", "channel_index")
    return rows.withColumn("_in", F.row_number().over(inner) - 1).join(bases, "block_id").withColumn("row_id", F.col("_base") + F.col("_in")).drop("_in", "_base")


def write_ledger(events: DataFrame, noise: DataFrame, path: str, floor: float, start: int, stop: int, step: int, extra: dict | None = None) -> "Ledger":
    """events: (sample_index, channel_index, amplitude_uv, snr) in [start, stop); noise: (channel_index, noise_uv)."""
    spark = events.sparkSession
    if not (math.isfinite(floor) and floor > 0 and step > 0 and start < stop):
        raise ValueError("a ledger needs a positive floor and step, and bounds")
    if not noise.where(~(F.col("noise_uv") > 0) | F.isnan("noise_uv")).isEmpty() or noise.isEmpty():
        raise ValueError("noise must be positive on every channel")
    if files.exists(spark, path) or files.exists(spark, path + ".partial"):
        raise FileExistsError(path)
    partial = path + ".partial"
    check_events(events, noise, floor, start, stop)
    named = ["row_id", "sample_index", "channel_index", "amplitude_uv", "snr"]
    numbered(events, step).select(*named, "block_id").repartition("block_id").sortWithinPartitions("block_id", "row_id").write.partitionBy("block_id").parquet(f"{partial}/events")
    noise.select("channel_index", "noise_uv").coalesce(1).write.parquet(f"{partial}/noise")
    _finish(spark, partial, {"format": FORMAT, "version": "1", "floor_snr": floor, "start_sample": start, "stop_sample": stop, "step": step, **(extra or {})})
    files.publish(spark, partial, path)
    return Ledger(spark, path)


def _finish(spark: SparkSession, partial: str, manifest: dict) -> None:
    """The block index covers the whole recording, blocks without events too."""
    step, start, stop = (manifest[k] for k in ("step", "start_sample", "stop_sample"))
    try:
        stored = spark.read.schema(EVENTS + ", block_id long").parquet(f"{partial}/events")
        found = {r.block_id: r.n for r in stored.groupBy("block_id").agg(F.count("*").alias("n")).collect()}  # a row per block
    except Exception as e:  # a ledger without events has no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = {}
    index, row = [], 0
    for b in range(start // step, -(-stop // step)):
        n = found.get(b, 0)
        index.append([b, max(start, b * step), min(stop, (b + 1) * step), row, row + n])
        row += n
    files.write_text(spark, f"{partial}/manifest.json", json.dumps(manifest | {"blocks": index, "rows": row, "complete": True}))


class Ledger:
    """An opened ledger; every fault of its index or schema is an error."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        if not files.exists(spark, f"{path}/manifest.json"):
            raise ValueError("incomplete ledger")
        self.manifest = m = json.loads(files.read_text(spark, f"{path}/manifest.json"))
        if not m.get("complete"):
            raise ValueError("incomplete ledger")
        if m.get("format") != FORMAT or m.get("version") not in VERSIONS:
            raise ValueError("unknown format or version")
        b = m["blocks"]
        joined = all(x[4] == y[3] and x[2] == y[1] for x, y in zip(b, b[1:], strict=False))
        if not b or not joined or b[0][3] != 0 or b[-1][4] != m["rows"] or any(x[4] < x[3] or x[2] <= x[1] for x in b):
            raise ValueError("broken block index")
        stored = spark.read.parquet(f"{path}/events") if m["rows"] else spark.createDataFrame([], EVENTS + ", block_id long")
        if {f.name for f in stored.schema} != {"row_id", "sample_index", "channel_index", "amplitude_uv", "snr", "block_id"}:
            raise ValueError("unexpected columns")
        self.spec = None
        if m["version"] == "2":
            self.spec = WaveformSpec.from_metadata(m["waveforms"])
        elif "waveforms" in m:
            raise ValueError("waveforms need version 2")

    def verify(self) -> None:
        """A pass over the data: rows by block, order of rows, and one waveform for every event."""
        m = self.manifest
        events = self.events()
        counts = {r.block_id: (r.n, r.a, r.b) for r in events.groupBy("block_id").agg(F.count("*").alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).collect()}  # a row per block
        for b, _, _, first, last in m["blocks"]:
            if counts.get(b, (0, None, None)) != ((last - first, first, last - 1) if last > first else (0, None, None)):
                raise ValueError(f"block {b} differs from the index")
        if self.spec is not None:
            lost = events.select("row_id").join(self.waveforms().select("row_id"), "row_id", "left_anti").isEmpty()
            if not lost or self.waveforms().count() != m["rows"]:
                raise ValueError("events and waveforms don't match row by row")

    def events(self) -> DataFrame:
        if not self.manifest["rows"]:
            return self.spark.createDataFrame([], EVENTS + ", block_id long")
        return self.spark.read.schema(EVENTS + ", block_id long").parquet(f"{self.path}/events")

    def noise(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/noise")

    def waveforms(self) -> DataFrame:
        """(row_id, valid_start, valid_stop, counts, block_id) as stored."""
        if self.spec is None:
            raise ValueError("this ledger has no waveforms")
        return self.spark.read.schema("row_id long, valid_start int, valid_stop int, counts array<int>, block_id long").parquet(f"{self.path}/waveforms")

    def _blocks(self, df: DataFrame, start: int | None, stop: int | None) -> DataFrame:
        """Only partitions of blocks that can hold rows in [start, stop): the folders of others are not listed for reading."""
        step = self.manifest["step"]
        if start is not None:
            df = df.where(F.col("block_id") >= start // step)
        if stop is not None:
            df = df.where(F.col("block_id") <= (stop - 1) // step)
        return df

    def query(self, snr: float, start: int | None = None, stop: int | None = None, channels: list[int] | None = None, polarity: str = "both") -> DataFrame:
        """Rows by SNR, half-open time, channels and polarity, with their row ids; reads the blocks of that time alone."""
        known = {r.channel_index for r in self.noise().select("channel_index").collect()} if channels is not None else None  # a row per channel
        found = select_events(self.events(), snr, self.manifest["floor_snr"], (start, stop), channels, known, polarity)
        return self._blocks(found, start, stop)

    def fetch(self, snr: float, **kwargs) -> DataFrame:
        """The same rows with their waveforms in microvolts, null outside what was recorded; event columns are filtered before waveforms are read."""
        chosen = self.query(snr, **kwargs)
        stored = self._blocks(self.waveforms(), kwargs.get("start"), kwargs.get("stop")).drop("block_id")
        spec = self.spec
        return chosen.join(stored, "row_id").withColumn("uv", decoded(F.col("counts"), F.col("valid_start"), F.col("valid_stop"), F.col("channel_index"), spec)).drop("counts")

    def batches(self, snr: float, rows: int = 10_000, **kwargs):
        """The rows of ``query`` in order, a bounded list at a time: one block after the other."""
        step, chosen = self.manifest["step"], self.query(snr, **kwargs)
        for b, _, _, first, last in self.manifest["blocks"]:
            start, stop = kwargs.get("start"), kwargs.get("stop")
            if last == first or (start is not None and (b + 1) * step <= start) or (stop is not None and b * step >= stop):
                continue
            part = []
            for r in chosen.where(F.col("block_id") == b).orderBy("row_id").toLocalIterator():
                part.append(r)
                if len(part) == rows:
                    yield part
                    part = []
            if part:
                yield part


def extend(ledger: Ledger, path: str, spec: WaveformSpec, waveforms: DataFrame, cores: DataFrame, provenance: dict) -> Ledger:
    """A new ledger with a waveform for every event.

    cores: (start, stop) of the voltage blocks that the waveforms (row_id,
    valid_start, valid_stop, counts) were cut from; they must be the ledger's
    blocks, each exactly once. The parent's digest goes into the manifest.
    """
    spark = ledger.spark
    if path.rstrip("/") == ledger.path.rstrip("/") or files.exists(spark, path) or files.exists(spark, path + ".partial"):
        raise FileExistsError(path)
    index = spark.createDataFrame([(b[1], b[2]) for b in ledger.manifest["blocks"]], "start long, stop long")
    if not mismatched(index, cores).isEmpty():
        raise ValueError("voltage blocks must cover every block of the ledger exactly once")
    partial, step = path + ".partial", ledger.manifest["step"]
    ledger.events().write.partitionBy("block_id").parquet(f"{partial}/events")
    ledger.noise().write.parquet(f"{partial}/noise")
    met = ledger.events().select("row_id", "sample_index").join(waveforms, "row_id")
    met.select("row_id", F.col("valid_start").cast("int").alias("valid_start"), F.col("valid_stop").cast("int").alias("valid_stop"), "counts", F.floor(F.col("sample_index") / step).alias("block_id")).write.partitionBy("block_id").parquet(f"{partial}/waveforms")
    parent = {"parent": ledger.path, "parent_sha256": files.digest(ledger.manifest)}
    base = {k: v for k, v in ledger.manifest.items() if k not in ("blocks", "rows", "complete")}
    _finish(spark, partial, base | {"version": "2", "waveforms": spec.metadata(), "provenance": provenance | parent})
    files.publish(spark, partial, path)
    made = Ledger(spark, path)
    made.verify()
    return made


def mismatched(index: DataFrame, cores: DataFrame) -> DataFrame:
    """Blocks without a core, cores without a block, and doubled ones."""
    count = lambda d, name: d.groupBy("start", "stop").agg(F.count("*").alias(name))
    both = count(index, "blocks").join(count(cores, "cores"), ["start", "stop"], "full")
    return both.where(~(F.coalesce("blocks", F.lit(0)) == 1) | ~(F.coalesce("cores", F.lit(0)) == 1))
