"""A run's journal: what it read and how it was set, which shards are done, and the models they left."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def source_record(spark: SparkSession, manifest: str, *paths: str) -> dict:
    """Sizes, times and digest that pin a session's sources."""
    listed = files.fingerprints(spark, *paths).select("path", "bytes", "modified").orderBy("path").collect()  # a row per file
    return {"manifest_sha256": files.fingerprints(spark, manifest).first().sha256, "sources": [{"path": r.path, "bytes": r.bytes, "modified": r.modified.isoformat()} for r in listed]}


class RunJournal:
    """``run.json`` in a new folder, or a run to be resumed with the very same sources and settings."""

    def __init__(self, spark: SparkSession, root: str, sources: dict, config: dict, resume: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.record = {"schema_version": 1, "source": sources, "config": config, "config_sha256": files.digest(config)}
        name = f"{self.root}/run.json"
        if resume:
            if not files.exists(spark, name) or json.loads(files.read_text(spark, name)) != self.record:
                raise ValueError("sources or settings differ from the run's")
        elif files.exists(spark, self.root):
            raise FileExistsError(root)
        else:
            files.write_text(spark, name, json.dumps(self.record))

    def _shard(self, probe: str, start: int, stop: int) -> str:
        return f"{self.root}/{probe}/{start:016d}-{stop:016d}"

    def publish(self, probe: str, start: int, stop: int, models: DataFrame, **tables: DataFrame) -> None:
        """Write a shard's tables and the models after it; the shard counts once it has its name."""
        final = self._shard(probe, start, stop)
        partial = final + ".partial"
        for name, df in {**tables, "models": models}.items():
            df.write.mode("overwrite").parquet(f"{partial}/{name}")
        files.write_text(self.spark, f"{partial}/shard.json", json.dumps({"start": start, "stop": stop, "config_sha256": self.record["config_sha256"], "complete": True}))
        files.publish(self.spark, partial, final)

    def completed(self, probe: str, start: int, stop: int) -> bool:
        path = self._shard(probe, start, stop)
        if not files.exists(self.spark, path):
            return False
        told = json.loads(files.read_text(self.spark, f"{path}/shard.json"))
        if not told["complete"] or told["config_sha256"] != self.record["config_sha256"]:
            raise ValueError("a shard is incomplete or of other settings")
        return True

    def open(self, planned: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The planned shards (probe, start, stop) that are left to do, in order."""
        return [s for s in planned if not self.completed(*s)]

    def table(self, probe: str, name: str, planned: list[tuple[int, int]]) -> DataFrame:
        """One table of all complete shards, in one frame, with the shard's start."""
        parts = [self.spark.read.parquet(f"{self._shard(probe, a, b)}/{name}").withColumn("shard_start", F.lit(a)) for a, b in planned if self.completed(probe, a, b)]
        if not parts:
            raise ValueError("no complete shard")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def latest_models(self, probe: str, before: int, planned: list[tuple[int, int]]) -> tuple[int, DataFrame] | None:
        """The models of the last complete shard that ends at ``before`` or earlier."""
        done = [(b, a) for a, b in planned if b <= before and self.completed(probe, a, b)]
        if not done:
            return None
        stop, start = max(done)
        return stop, self.spark.read.parquet(f"{self._shard(probe, start, stop)}/models")


def run_shards(journal: RunJournal, probe: str, planned: list[tuple[int, int]], seed: DataFrame, sort) -> int:
    """Do what is left, in order, models carried from shard to shard. sort(start, stop, models) gives (tables, models after). Returns the shards done."""
    done = 0
    for start, stop in planned:
        if journal.completed(probe, start, stop):
            continue
        before = journal.latest_models(probe, start, planned)
        tables, after = sort(start, stop, before[1] if before else seed)
        journal.publish(probe, start, stop, after, **tables)
        done += 1
    return done
