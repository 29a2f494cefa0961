"""Virtual sessions of many files, shards, models by time, and links across days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(sources: DataFrame) -> DataFrame:
    """Where each file begins on the session's clock. A row per file."""
    order = Window.orderBy("file_id")
    return sources.withColumn("start", F.sum("samples").over(order) - F.col("samples")).withColumn("stop", F.col("start") + F.col("samples"))


def locate(points: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """(t, file_id, local) of every point; points outside all files have null. Files are ``width`` samples long at least."""
    b = lambda c: F.floor(c / width)
    spread = files.withColumn("_b", F.explode(F.sequence(b(F.col("start")), b(F.col("stop") - 1))))
    p = points.withColumn("_pb", b(F.col("t")))
    met = p.join(spread, (p["_pb"] == spread["_b"]) & (p["t"] >= spread["start"]) & (p["t"] < spread["stop"]), "left")
    return met.select("row_id", "t", "file_id", (F.col("t") - F.col("start")).alias("local"))


def shard_intervals(segments: DataFrame, step: int) -> DataFrame:
    """Every segment in pieces of ``step`` samples, the last one shorter."""
    made = segments.withColumn("shard_start", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(step).cast("long"))))
    return made.select("file_id", "shard_start", F.least(F.col("shard_start") + step, F.col("stop")).alias("shard_stop"))


def undeclared_gaps(segments: DataFrame, declared: DataFrame) -> DataFrame:
    """Gaps between segments that no declaration matches, and the other way round."""
    nxt = F.lead("start").over(Window.partitionBy("probe").orderBy("start"))
    gaps = segments.withColumn("_n", nxt).where(F.col("_n") > F.col("stop")).select("probe", F.col("stop").alias("gap_start"), F.col("_n").alias("gap_stop"))
    return gaps.exceptAll(declared).withColumn("why", F.lit("undeclared")).unionByName(declared.exceptAll(gaps).withColumn("why", F.lit("not a gap")))


def boundary_radius(fits: DataFrame, base: int, least: int = 20, share: float = 0.05) -> DataFrame:
    """Per unit the shift radius after a pilot: one more where enough fits lie on the boundary."""
    edge = F.avg((F.abs("shift") >= base).cast("double"))
    return fits.groupBy("unit").agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & (edge >= share), base + 1).otherwise(base).cast("long").alias("radius"))


def pilot_radius(fits: DataFrame, base: int, rate: float, seconds: float = 30.0, least: int = 20, share: float = 0.05) -> DataFrame:
    """The same from fits (unit, t, shift) of the first ``seconds`` in which there are any, for all units that have some later too."""
    first = fits.agg(F.min("t").alias("_first"))  # one row
    early = fits.crossJoin(F.broadcast(first)).where(F.col("t") < F.col("_first") + int(seconds * rate)).drop("_first")
    told = boundary_radius(early, base, least, share)
    return fits.select("unit").distinct().join(told, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(base).cast("long")).alias("radius"))


def log_progress(logs: DataFrame) -> DataFrame:
    """(id, done, total, eta_seconds) from the last counter of a progress log, as 'done/total [.. <h:mm:ss, ..]'. logs: (id, log)."""
    found = F.regexp_extract_all("log", F.lit(r"[0-9,]+\s*/\s*[0-9,]+\s*\[[^\]\r\n]*\]"), F.lit(0))
    told = logs.withColumn("_m", F.element_at(found, -1)).where(F.size(found) > 0)
    number = lambda g: F.regexp_replace(F.regexp_extract("_m", r"([0-9,]+)\s*/\s*([0-9,]+)", g), ",", "").cast("long")
    eta = r"<\s*(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})\s*,"
    part = lambda g: F.coalesce(F.nullif(F.regexp_extract("_m", eta, g), F.lit("")).cast("long"), F.lit(0))
    told = told.withColumn("done", number(1)).withColumn("total", number(2))
    return told.where("total > 0 and done <= total").select("id", "done", "total", F.when(F.col("_m").rlike(eta), part(1) * 3600 + part(2) * 60 + part(3)).alias("eta_seconds"))


def job_progress(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """(job, percent, stage): weighted stages up to the last that a job has begun. steps: (place, stage, weight); tasks: (job, stage, done, total).

    Stages before the last count as whole, and the last one as 99 % at most, so
    the figure never falls while a job runs.
    """
    at = tasks.join(F.broadcast(steps), "stage")
    here = at.groupBy("job").agg(F.max_by(F.struct("place", "stage", F.least(F.col("done") / F.greatest(F.col("total"), F.lit(1)), F.lit(0.99)).alias("part"), "weight"), "place").alias("h"))
    before = steps.select("place", F.sum("weight").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("weight").over(Window.partitionBy()).alias("all"))  # a row per stage
    met = here.join(F.broadcast(before), F.col("h.place") == before["place"])
    return met.select("job", (100 * (F.coalesce("before", F.lit(0)) + F.col("h.weight") * F.col("h.part")) / F.col("all")).alias("percent"), F.col("h.stage").alias("stage"))


def natural_key(column: str):
    """Digits compare as numbers: each run is padded to twenty."""
    parts = F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
