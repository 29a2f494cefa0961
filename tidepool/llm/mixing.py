"""Mixing sources to target weights by capped water-filling (operator 9).

A source may be repeated ``max_epochs`` times at most. Sources that would need
more are clamped there and their excess goes to the others by weight, until no
target is above its clamp. In closed form: with sources in order of clamp over
weight, the first k are clamped where the level (what is left over the weights
that are left) first is no higher than the next one's ratio. The sources' table
is small; rows meet it by a broadcast that is checked, and large tables of
sources are joined by a shuffle instead.

A source's documents are laid out in seeded random order (a hash of seed and
id). Every document is repeated floor(target / size) times and the front of the
order once more, up to the rest of the target. The place of a document in that
order comes from a histogram over the hash's leading bits, summed per bin, so
only the bin in which the rest ends is ever sorted; bins hold a small share of
any source, however large, and all of it counts.

Only built-in DataFrame functions run here. Edge cases: a null text has size 0;
a null source is a source of its own, last in order; a null id is hashed as
'null'; rows with equal ids are ordered by size, and equal rows are as one in
any order; an empty table gives an empty result; sources without any word have
target 0; ``apply_mix`` keeps the table's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BIN_BITS = 12
#: Sources beyond this are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def sizes(df: DataFrame, text_column: str = "text") -> Column:
    """Words of a text: runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")


def draw(seed: int, id_column: str = "doc_id") -> Column:
    """52 seeded bits of an id."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 13), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources: (source, source_size, weight). Adds target: the weight's share of all sizes under the clamps."""
    order = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = sources.withColumn("clamp", F.col("source_size") * max_epochs).select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("clamp").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights_left"),
    )
    free = F.col("left") * F.col("weight") <= F.col("clamp") * F.col("weights_left")  # the level is under this one's ratio
    first = F.min(F.when(free, F.struct(F.col("clamp") / F.col("weight"), F.col("left"), F.col("weights_left")))).over(all_rows)
    filled = F.col("weight") * first["left"] / first["weights_left"]
    return level.select("source", "source_size", "weight", F.coalesce(F.least(F.col("clamp").cast("double"), filled), F.col("clamp").cast("double")).alias("target"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sized: (source, size). One row per source, weights dealt in code-point order, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return water_fill(per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))), max_epochs)


def mix(df: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken, tie) of every row; tie is a hash of its text."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), sizes(df, text_column).alias("size"), draw(seed, id_column).alias("draw"), F.xxhash64(text_of(text_column)).alias("tie"))
    # ids and sizes are small; writing them spares two more passes over the texts
    rows = written(rows.withColumn("bin", F.shiftright("draw", 52 - BIN_BITS)), "sizes")
    sources = written(source_targets(rows, weights, max_epochs), "sources")
    rest = F.col("target") - F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))) * F.col("source_size")
    sources = sources.select("source", "source_size", "target", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).alias("whole"), rest.alias("rest"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "bin", "in_bin", F.coalesce(F.sum("in_bin").over(by_bin), F.lit(0)).alias("before"))
    few = sources.count() <= BROADCAST_SOURCES
    small = lambda d: F.broadcast(d) if few else d
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edge = bins.join(small(sources), same(bins, sources)).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bin") >= F.col("rest"))).select(bins["source"], "bin", "before")
    # exactly one bin of each source at most, so as small as the sources
    edge = sources.join(small(edge), same(sources, edge), "left").select(sources["source"], "source_size", "target", "whole", "rest", F.col("bin").alias("edge"), "before")
    joined = rows.join(small(edge), same(rows, edge)).drop(edge["source"])
    wide = joined.withColumn("at_edge", F.col("bin").eqNullSafe(F.col("edge")))
    inside = wide.where("at_edge").withColumn("front", F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = inside.withColumn("extra", F.when(F.col("front") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
    outside = wide.where("not at_edge").withColumn("extra", F.when((F.col("rest") > 0) & (F.coalesce(F.col("bin") < F.col("edge"), F.lit(True))), 1).otherwise(0))
    both = inside.drop("front").unionByName(outside).withColumn("repeats", F.col("whole") + F.col("extra"))
    out = both.select("doc_id", "source", "size", "source_size", "target", F.col("repeats").cast("int").alias("repeats"), (F.col("repeats") * F.col("size")).alias("taken"), "tie")
    return out


def mixture(df: DataFrame, seed: int = 17) -> DataFrame:
    """The words that the mix takes of every document."""
    return mix(df, seed).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(df: DataFrame, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The mixed rows themselves: each row as often as the mix repeats it.

    Rows equal in id, source and text share their repetitions evenly, rounded
    down, as nothing tells them apart.
    """
    plan = mix(df, seed, id_column=id_column, source_column=source_column, text_column=text_column, **options)
    most = plan.groupBy("doc_id", "source", "tie").agg(F.floor(F.sum("repeats") / F.count("*")).cast("int").alias("copies")).where("copies > 0")
    names = {c: fresh(df, f"mix_{c}") for c in [*most.columns, "copy"]}
    most = most.withColumnsRenamed(names)
    met = df.join(most, df[id_column].eqNullSafe(F.col(names["doc_id"])) & df[source_column].eqNullSafe(F.col(names["source"])) & (F.xxhash64(F.coalesce(df[text_column], F.lit(""))) == F.col(names["tie"])))
    return met.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).drop(*names.values())


#: DuckDB's form, over whole sources in one window each.
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(sha256('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint as draw from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
l as (select *, 3 * source_size as clamp, (select sum(source_size) from s) - coalesce(sum(3 * source_size) over o, 0) as rest_size,
  (select sum(weight) from w) - coalesce(sum(weight) over o, 0) as rest_weight from w
  window o as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select rest_size, rest_weight from l where rest_size * weight <= clamp * rest_weight order by clamp / weight, source nulls last limit 1),
t as (select source, source_size, coalesce(least(clamp::double, (weight * (select rest_size from f))::double / (select rest_weight from f)::double), clamp::double) as target from l),
e as (select *, floor(target / greatest(source_size, 1)) as whole, target - floor(target / greatest(source_size, 1)) * source_size as rest from t),
j as (select d.doc_id, d.size, e.source_size, e.target, e.whole, e.rest,
  coalesce(sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as front
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and front + size / 2 <= rest then 1 else 0 end))::bigint as taken from j
"""
