"""Assignment of events to rolling templates, epoch by epoch, as batch or stream.

The rule that makes restarts exact: an epoch's events are assigned against a
frozen version of the templates, written under the epoch's own number, and only
then does the state of the next version get its name. What a lost attempt left
behind is overwritten by the next one.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import epoch_isolated
from ..operators.templates import CELLS, contact_matches, near_best, shifted_match  # noqa: F401 (a name of this module too)
from ..sources import files

STATE = "unit long, anchor long, contacts array<long>, w array<double>, last array<double>, assigned long, bins array<struct<bin:long,total:array<double>,n:long>>"

SLICES = 4  # of an anchor's events


def epochs(events: DataFrame, bin_samples: int, most: int) -> DataFrame:
    """Adds ``epoch``: (time bin, piece), a piece being cut before the sample that would take it over ``most`` events.

    All events of a sample stay together; more than ``most`` of them are an error.
    """
    t_bin = F.floor(F.col("t") / bin_samples)
    per = events.groupBy(t_bin.alias("_bin"), "t").agg(F.count("*").alias("_n"))
    # greedy pieces: the running count since the last cut, carried through the bin's samples in order
    lists = per.groupBy("_bin").agg(F.sort_array(F.collect_list(F.struct("t", "_n"))).alias("_s"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("piece"), F.array().cast("array<struct<t:bigint,piece:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        cut = a["sum"] >= most
        piece = a["piece"] + F.when(cut, 1).otherwise(0)
        return F.struct((F.when(cut, F.lit(0)).otherwise(a["sum"]) + x["_n"]).alias("sum"), piece.alias("piece"), F.concat(a["out"], F.array(F.struct(x["t"].alias("t"), piece.alias("piece")))).alias("out"))

    crowded = F.when(F.exists("_s", lambda x: x["_n"] > most), F.raise_error(F.lit("too many events at one sample")).cast("boolean")).otherwise(F.lit(True))
    cut = lists.where(crowded).select("_bin", F.explode(F.aggregate("_s", zero, step)["out"]).alias("x")).select("_bin", F.col("x.t").alias("t"), F.col("x.piece").alias("_piece"))
    return events.withColumn("_bin", t_bin).join(cut, ["_bin", "t"]).withColumn("epoch", F.struct(F.col("_bin").alias("bin"), F.col("_piece").alias("piece"))).drop("_bin", "_piece")


def assigned(events: DataFrame, state: DataFrame, score: float = 0.88, margin: float = 0.03) -> DataFrame:
    """events (row_id, t, channel, contacts, w) with (unit, score, runner, margin, amplitude, shift, teaches); unit is -1 where score or margin don't suffice.

    All templates anchored on an event's contacts are tried, however many: by
    anchor, in matrices that leave few to be scored one by one.
    """
    whole = F.forall("w", lambda x: x.isNotNull())
    part = F.pmod(F.xxhash64("row_id"), F.lit(SLICES))
    near = events.select(F.explode("contacts").alias("anchor"), part.alias("part"), "row_id", "channel", F.col("contacts").alias("rc"), F.col("w").alias("rw"), whole.alias("whole")).where("anchor >= 0")
    bank = state.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("part"), "unit", F.col("contacts").alias("lc"), F.col("last").alias("lw"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("row_id",)} | {"unit": state.schema["unit"].dataType.simpleString()}
    names = ["row_id", "unit", "score", "amplitude", "shift", "same"]

    def two(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: [] for c in names})]
        shaped = lambda v: np.stack([np.asarray(w, float) for w in v]).reshape(len(v), 16, -1)
        y = y.assign(rc=y["rc"].map(tuple))
        for lc, bank_part in x.assign(lc=x["lc"].map(tuple)).groupby("lc"):
            lw, units, left = shaped(bank_part["lw"]), bank_part["unit"].to_numpy(), np.array(lc)
            for rc, seen in y.groupby("rc"):
                step = max(1, CELLS // len(lw))
                for at in range(0, len(seen), step):
                    piece = seen.iloc[at : at + step]
                    rw, right = shaped(piece["rw"]), np.array(rc)
                    i, j = near_best(lw, left, rw, right, 2)
                    told = [contact_matches(lw[p], np.tile(left, (len(p), 1)), rw[q], np.tile(right, (len(q), 1)), 2, 0.7, 0.9, False) for p, q in ((i[n : n + 4096], j[n : n + 4096]) for n in range(0, len(i), 4096))]
                    if not told:
                        continue
                    value, amplitude, shift = (np.concatenate(v) for v in zip(*told, strict=True))
                    order = np.lexsort((-units[i], -value, j))
                    order = order[value[order] > -1]
                    order = order[np.arange(len(order)) - np.searchsorted(j[order], j[order]) < 2]
                    i, j, value, amplitude, shift = i[order], j[order], value[order], amplitude[order], shift[order]
                    own = piece["whole"].to_numpy()[j] & (piece["channel"].to_numpy()[j] == bank_part["anchor"].iloc[0]) & (lc == rc)
                    found.append(pd.DataFrame({"row_id": piece["row_id"].to_numpy()[j], "unit": units[i], "score": value, "amplitude": amplitude, "shift": shift, "same": own}))
        found = [f for f in found if len(f)] or found
        return pd.concat(found)

    scored = near.groupBy("anchor", "part").cogroup(bank.groupBy("anchor", "part")).applyInPandas(lambda y, x: two(x, y) if len(x) and len(y) else pd.DataFrame({c: [] for c in names}), f"row_id {kinds['row_id']}, unit {kinds['unit']}, score double, amplitude double, shift int, same boolean")
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), F.desc("unit"))
    top = scored.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    of = lambda r, c: F.max(F.when(F.col("_r") == r, c))
    told = top.groupBy("row_id").agg(of(1, F.struct("unit", "score", "amplitude", "shift", "same")).alias("b"), F.coalesce(of(2, F.col("score")), F.lit(0.0)).alias("runner"))
    gap = F.col("b.score") - F.greatest(F.col("runner"), F.lit(0.0))
    ok = (F.col("b.score") >= score) & (gap >= margin)
    teaches = ok & (F.col("b.score") >= 0.96) & (gap >= 0.08) & (F.col("b.shift") == 0) & F.col("b.amplitude").between(0.5, 2.0) & F.col("b.same")
    found = told.select("row_id", F.when(ok, F.col("b.unit")).otherwise(-1).alias("unit"), F.col("b.score").alias("score"), "runner", gap.alias("margin"), F.col("b.amplitude").alias("amplitude"), F.col("b.shift").alias("shift"), teaches.alias("teaches"))
    return events.join(found, "row_id", "left").withColumn("unit", F.coalesce("unit", F.lit(-1).cast("long"))).withColumn("teaches", F.coalesce("teaches", F.lit(False)))


class RollingTemplates:
    """Versions of a bank's rolling templates below a folder; ``state.json`` names the one that counts.

    A template is the mean of its recent bins' means, each weighted by its spikes,
    ``cap`` at most; bins older than the window go; without any the last shape
    stays as it is.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.meta = json.loads(files.read_text(spark, f"{self.folder}/state.json"))

    @classmethod
    def begin(cls, spark: SparkSession, folder: str, bank: DataFrame, frame: str, bin_samples: int, window_bins: int, start: int = 0, least_spikes: int = 1, least_confidence: float = 0.95, cap: int = 100) -> "RollingTemplates":
        """bank: (unit, anchor, contacts, w)."""
        if files.exists(spark, f"{folder}/state.json"):
            raise FileExistsError(folder)
        if not frame or bin_samples < 1 or window_bins < 1 or start < 0 or least_spikes < 1 or not 0 <= least_confidence <= 1 or cap < 1:
            raise ValueError("bad settings of rolling templates")
        empty = F.array().cast("array<struct<bin:bigint,total:array<double>,n:bigint>>")
        bank.select("unit", "anchor", "contacts", "w", F.col("w").alias("last"), F.lit(0).cast("long").alias("assigned"), empty.alias("bins")).write.mode("overwrite").parquet(f"{folder}/version=0")
        files.write_text(spark, f"{folder}/state.json", json.dumps({"version": 0, "through": start, "frame": frame, "bin_samples": bin_samples, "window_bins": window_bins, "least_spikes": least_spikes, "least_confidence": least_confidence, "cap": cap}))
        return cls(spark, folder)

    def snapshot(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/version={self.meta['version']}")

    def commit(self, start: int, stop: int, summaries: DataFrame | None, frame: str, expected_version: int) -> None:
        """Advance over [start, stop). summaries: (unit, mean, n, confidence, assigned).

        A stale version, another frame, and anything before what has been
        committed are errors: late data is refused, never dropped in silence.
        """
        m = self.meta
        now = json.loads(files.read_text(self.spark, f"{self.folder}/state.json"))["version"]
        if expected_version != m["version"] or now != m["version"] or frame != m["frame"] or start < m["through"] or stop <= start:
            raise ValueError("stale, overlapping or incompatible update")
        state, size = self.snapshot(), m["bin_samples"]
        if summaries is not None:
            good = (F.col("n") >= m["least_spikes"]) & (F.col("confidence") >= m["least_confidence"])
            if start // size != (stop - 1) // size and not summaries.where(good).isEmpty():
                raise ValueError("a summary crosses the border of a time bin")
            add = summaries.select("unit", F.col("assigned").alias("_assigned"), F.when(good, F.struct(F.lit(start // size).cast("long").alias("bin"), F.transform("mean", lambda x: x * F.col("n")).alias("total"), F.col("n").cast("long").alias("n"))).alias("_add"))
            state = state.join(add, "unit", "left")
        else:
            state = state.withColumn("_assigned", F.lit(0).cast("long")).withColumn("_add", F.lit(None).cast("struct<bin:bigint,total:array<double>,n:bigint>"))
        oldest = (stop - 1) // size - m["window_bins"] + 1
        same = F.filter("bins", lambda b: b["bin"] == F.col("_add.bin"))[0]
        merged = F.when(F.get(F.filter("bins", lambda b: b["bin"] == F.col("_add.bin")), F.lit(0)).isNotNull(), F.struct(F.col("_add.bin").alias("bin"), F.zip_with(same["total"], F.col("_add.total"), lambda a, b: a + b).alias("total"), (same["n"] + F.col("_add.n")).alias("n"))).otherwise(F.col("_add"))
        bins = F.when(F.col("_add").isNotNull(), F.concat(F.filter("bins", lambda b: b["bin"] != F.col("_add.bin")), F.array(merged))).otherwise(F.col("bins"))
        state = state.withColumn("bins", F.filter(bins, lambda b: b["bin"] >= oldest))
        weight = lambda b: F.least(b["n"], F.lit(m["cap"])).cast("double")
        zero = F.transform("last", lambda x: F.lit(0.0))
        mean = F.transform(F.aggregate("bins", zero, lambda a, b: F.zip_with(a, b["total"], lambda x, y: x + y / b["n"] * weight(b))), lambda x: x / F.aggregate("bins", F.lit(0.0), lambda a, b: a + weight(b)))
        state = state.withColumn("last", F.when(F.size("bins") > 0, mean).otherwise(F.col("last"))).withColumn("assigned", F.col("assigned") + F.coalesce("_assigned", F.lit(0)))
        version = m["version"] + 1
        state.select("unit", "anchor", "contacts", "w", "last", "assigned", "bins").write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        files.write_text(self.spark, f"{self.folder}/state.json", json.dumps(m | {"version": version, "through": stop}))
        self.meta = m | {"version": version, "through": stop}


def sort_epochs(events: DataFrame, templates: RollingTemplates, out: str, patches: DataFrame, length: int, most: int = 4096) -> int:
    """Events (row_id, t, channel, contacts, w) in order of epochs: assign, write below ``out``, commit. Returns the epochs done.

    Epochs follow one another, as each sees the templates that the one before has
    moved; the work of an epoch is distributed. Events before what is committed
    are an error. The list of epochs is a row per epoch.
    """
    spark = events.sparkSession
    through = templates.meta["through"]
    if not events.where(F.col("t") < through).isEmpty():
        raise ValueError("late events: they lie before what has been committed")
    marked = epochs(events, templates.meta["bin_samples"], most).persist()
    done = 0
    try:
        isolated = epoch_isolated(marked.select("row_id", "t", "channel", "epoch"), patches, length).select("row_id", "isolated").persist()
        listed = marked.groupBy("epoch").agg(F.min("t").alias("first"), F.max("t").alias("last")).orderBy("epoch").collect()
        for e in listed:
            version, size = templates.meta["version"], templates.meta["bin_samples"]
            begin = e.first // size * size
            if templates.meta["through"] < begin:  # idle time goes by without spikes
                templates.commit(templates.meta["through"], begin, None, templates.meta["frame"], version)
                version += 1
            part = marked.where((F.col("epoch.bin") == e.epoch.bin) & (F.col("epoch.piece") == e.epoch.piece)).drop("epoch")
            rows = assigned(part, templates.snapshot()).join(isolated, "row_id").withColumn("version", F.lit(version))
            rows.drop("w").write.mode("overwrite").parquet(f"{out}/epoch={version}")
            told = spark.read.parquet(f"{out}/epoch={version}").where("unit >= 0")
            taught = told.where("teaches and isolated").select("row_id", "unit").join(part.select("row_id", "w"), "row_id")
            means = taught.select("unit", F.posexplode("w").alias("i", "x")).groupBy("unit", "i").agg(F.avg("x").alias("x")).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
            counts = told.groupBy("unit").agg(F.count("*").alias("assigned"), F.sum((F.col("teaches") & F.col("isolated")).cast("long")).alias("n"))
            summaries = counts.join(means, "unit", "left").withColumn("confidence", F.when(F.col("n") > 0, 1.0).otherwise(0.0))
            templates.commit(templates.meta["through"], e.last + 1, summaries, templates.meta["frame"], version)
            done += 1
        isolated.unpersist()
    finally:
        marked.unpersist()
    return done


def sort_stream(stream: DataFrame, folder: str, patches: DataFrame, length: int, most: int = 4096) -> StreamingQuery:
    """The same on a stream: every micro-batch is sorted by epochs; one that comes again after a crash goes on where it stopped."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        templates = RollingTemplates(spark, f"{folder}/templates")
        mark = f"{folder}/batch-{number}.json"
        first = json.loads(files.read_text(spark, mark))["through"] if files.exists(spark, mark) else templates.meta["through"]
        files.write_text(spark, mark, json.dumps({"through": first}))
        if not rows.where(F.col("t") < first).isEmpty():
            raise ValueError("late events: they lie before what has been committed")
        sort_epochs(rows.where(F.col("t") >= templates.meta["through"]), templates, f"{folder}/assigned", patches, length, most)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
