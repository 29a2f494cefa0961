"""The quality report: one-to-one scores of a sorting against ground truth, and the gate over a suite of cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import collisions, interval_pairs, two_pointer, unit_assignment


def matched_spikes(truth: DataFrame, found: DataFrame, pairs: DataFrame, tolerance: int) -> DataFrame:
    """(label, label2, t, t2, hit): the greedy one-to-one match of each pair's times, and with a null t2 what of the truth it misses.

    A pair's times are cut wherever neither side has any for more than
    ``tolerance``; no match spans such a gap, so every piece is a task's row group
    of its own and long pairs are spread.
    """
    a = truth.select("t", F.col("label").alias("label")).join(pairs, "label").select("label", "label2", "t", F.lit(0).alias("side"))
    b = found.select("t", F.col("label").alias("label2")).join(pairs, "label2").select("label", "label2", "t", F.lit(1).alias("side"))
    both = a.unionByName(b)
    order = Window.partitionBy("label", "label2").orderBy("t", "side")
    piece = F.sum(F.when(F.col("t") - F.lag("t").over(order) <= tolerance, 0).otherwise(1)).over(order)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                left, right = np.array(r.left_t, np.int64), np.array(r.right_t, np.int64)
                i, j = two_pointer(left, right, tolerance)
                partner = dict(zip(i.tolist(), j.tolist(), strict=True))
                out += [(r.label, r.label2, int(t), int(right[partner[k]]) if k in partner else None) for k, t in enumerate(left)]
            yield pd.DataFrame(out, columns=["label", "label2", "t", "t2"]).astype({"t2": "Int64"})

    times = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    pieces = both.withColumn("_p", piece).groupBy("label", "label2", "_p").agg(times(0).alias("left_t"), times(1).alias("right_t"))
    alone = pieces.where(F.size("right_t") == 0).select("label", "label2", F.explode("left_t").alias("t"), F.lit(None).cast("long").alias("t2"))
    met = pieces.where((F.size("right_t") > 0) & (F.size("left_t") > 0)).select("label", "label2", "left_t", "right_t")
    schema = f"label {truth.schema['label'].dataType.simpleString()}, label2 {found.schema['label'].dataType.simpleString()}, t long, t2 long"
    return alone.unionByName(met.mapInPandas(match, schema))


def pair_counts(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """(label, label2, matched, n, n2, iou) of the pairs of units that ever meet."""
    met = interval_pairs(truth, found, tolerance).select("label", "label2").distinct()
    n = truth.groupBy("label").agg(F.count("*").alias("n"))
    n2 = found.groupBy(F.col("label").alias("label2")).agg(F.count("*").alias("n2"))
    matched = matched_spikes(truth, found, met, tolerance).groupBy("label", "label2").agg(F.count("t2").alias("matched"))
    return matched.join(n, "label").join(n2, "label2").withColumn("iou", F.col("matched") / (F.col("n") + F.col("n2") - F.col("matched")))


def missed(truth: DataFrame, found: DataFrame, links: DataFrame, tolerance: int) -> DataFrame:
    """(label, t) of the truth that its linked unit doesn't match."""
    return matched_spikes(truth, found, links.select("label", "label2"), tolerance).where("t2 is null").select("label", "t")


def score_sorting(truth: DataFrame, found: DataFrame, tolerance: int, collision: int | None = None, late: float | None = None) -> DataFrame:
    """One row of counts and rates. truth, found: (t, label)."""
    pairs = pair_counts(truth, found, tolerance)
    links = unit_assignment(truth, found, tolerance)
    linked = links.select("label", "label2").join(pairs, ["label", "label2"])
    span = truth.agg(((F.min("t") + F.max("t")) / 2).alias("m")).first()  # one row
    middle = late if late is not None else (span.m or 0)
    units = truth.groupBy("label").agg(F.count("*").alias("n"), (F.min("t") > middle).alias("late")).withColumn("rare", F.col("n") <= 50)
    hit = collisions(truth, tolerance if collision is None else collision)
    collided = hit.select("t", "label").unionByName(hit.select(F.col("before_t").alias("t"), F.col("before_label").alias("label"))).distinct()
    got = matched_spikes(truth, found, links.select("label", "label2"), tolerance).where("t2 is not null").select("label", "t")
    strong = linked.where("iou >= 0.8").select("label").withColumn("recovered", F.lit(True))
    per = units.join(strong, "label", "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    one = per.agg(F.count("*").alias("units"), count(F.col("recovered")).alias("recovered_units"), count(F.col("rare")).alias("rare_units"), count(F.col("rare") & F.col("recovered")).alias("rare_recovered"), count(F.col("late")).alias("late_units"), count(F.col("late") & F.col("recovered")).alias("late_recovered"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    two = found.agg(F.countDistinct("label").alias("found_units"), F.count("*").alias("_n2"))
    three = linked.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("true_positives"))
    split = pairs.where(F.col("matched") >= 0.2 * F.col("n")).groupBy("label").count().agg(count(F.col("count") >= 2).alias("split_units"))
    merged = pairs.where(F.col("matched") >= 0.2 * F.col("n2")).groupBy("label2").count().agg(count(F.col("count") >= 2).alias("merged_units"))
    four = collided.join(got.withColumn("_got", F.lit(True)), ["label", "t"], "left").agg(F.count("*").alias("collision_spikes"), count(F.col("_got").isNotNull()).alias("collision_recovered"))
    row = one
    for other in (two, three, split, merged, four):  # one row each
        row = row.crossJoin(other)
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    row = row.withColumn("precision", rate(F.col("true_positives"), F.col("_n2"))).withColumn("recall", rate(F.col("true_positives"), F.col("_n")))
    return row.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_n", "_n2")


KINDS = ("base", "drift", "collision")


def suite_gate(cases: DataFrame) -> DataFrame:
    """One row: whether a suite is complete and passes. cases: (name, kind, route, units, recovered_units, precision, recall, collision_spikes, collision_recovered, rare_units, rare_recovered, late_units, late_recovered).

    Routes are 'session' and 'baseline'. At least three cases of all kinds; mean
    losses of 2 %, and of 5 % in any subgroup of any case, are the most allowed.
    """
    side = lambda r, p: cases.where(F.col("route") == r).select("name", "kind", *[F.col(c).alias(f"{p}_{c}") for c in cases.columns if c not in ("name", "kind", "route")])
    met = side("session", "s").join(side("baseline", "b").drop("kind"), "name")
    rate = lambda n, d: F.when(F.col(f"s_{d}") > 0, (F.col(f"b_{n}") - F.col(f"s_{n}")) / F.col(f"s_{d}"))
    losses = [rate("recovered_units", "units"), F.col("b_precision") - F.col("s_precision"), F.col("b_recall") - F.col("s_recall"), rate("collision_recovered", "collision_spikes"), rate("rare_recovered", "rare_units"), rate("late_recovered", "late_units")]
    told = met.withColumn("_worst", F.greatest(*losses))
    ready = (F.count("*") >= 3) & (F.size(F.array_intersect(F.collect_set("kind"), F.array(*map(F.lit, KINDS)))) == len(KINDS)) & (F.min("s_units") > 0)
    out = told.agg(ready.alias("complete"), (F.sum(F.col("b_recovered_units") - F.col("s_recovered_units")) / F.sum("s_units")).alias("recovery_loss"), F.avg(F.col("b_precision") - F.col("s_precision")).alias("precision_loss"), F.avg(F.col("b_recall") - F.col("s_recall")).alias("recall_loss"), F.max("_worst").alias("worst_subgroup_loss"))
    passed = F.col("complete") & (F.col("recovery_loss") <= 0.02) & (F.col("precision_loss") <= 0.02) & (F.col("recall_loss") <= 0.02) & (F.col("worst_subgroup_loss") <= 0.05)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def interval_report(spikes: DataFrame, limit: int, step: int) -> DataFrame:
    """Per shard of ``step`` samples: spikes, units, short intervals and their share; a unit's first interval in a shard reaches back into the shard before.

    Times are cut by (label, shard), and each shard's last time is carried on, so no
    unit is one task.
    """
    rows = spikes.withColumn("shard", F.floor(F.col("t") / step))
    inner = Window.partitionBy("label", "shard").orderBy("t")
    last = rows.groupBy("label", "shard").agg(F.max("t").alias("_last"))
    before = last.select("label", "shard", F.lag("_last").over(Window.partitionBy("label").orderBy("shard")).alias("_before"))  # a row per unit and shard
    gaps = rows.withColumn("_p", F.lag("t").over(inner)).join(before, ["label", "shard"]).withColumn("_g", F.col("t") - F.coalesce("_p", "_before"))
    return gaps.groupBy("shard").agg(F.count("*").alias("spikes"), F.countDistinct("label").alias("units"), F.count("_g").alias("intervals"), F.coalesce(F.sum((F.col("_g") < limit).cast("long")), F.lit(0)).alias("short")).withColumn("share", F.col("short") / F.greatest(F.col("intervals"), F.lit(1)))


def unit_times(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy("label").agg(F.sort_array(F.collect_list("t")).alias("times"))


def memory_report(cores: DataFrame, step: int) -> DataFrame:
    """Per shard the median and peaks of what its cores used. cores: (stop, rss, pool)."""
    shard = F.ceil(F.col("stop") / step) - 1
    return cores.groupBy(shard.alias("shard")).agg(F.median("rss").alias("median_rss"), F.max("rss").alias("peak_rss"), F.max("pool").alias("peak_pool"))
