"""Joins between spikes, events, models and days: links across days, unknown events, isolation, look-ups and remaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import guarded, within
from .templates import SLOTS, shifted_match


def contact_cosines(pairs: DataFrame, share: float = 0.7, shifts: int = 2, times: int = 16, whole: bool = False) -> DataFrame:
    """Adds score, the best cosine over shifts on the contacts both sides have, -1 where these hold under ``share`` of either's energy.

    pairs: (..., lw, lc, rw, rc) with flat waveforms and contact lists (-1: none).
    ``whole``: energies of all contacts go into the denominator.
    """
    met = shifted_match(F.col("lw"), F.col("lc"), F.col("rw"), F.col("rc"), times, shifts, share, 0.0, whole)
    return pairs.withColumn("score", met["score"])


def cross_day_links(models: DataFrame, channels: DataFrame, radius: float = 200.0, most: int = 256) -> DataFrame:
    """Candidate links between the last models of a day and the first of the next; never identities.

    models: (probe, day, day_index, unit, anchor, contacts, w, assigned);
    channels: (channel, x, y, shank). Anchors share a shank within ``radius``;
    more than ``most`` of them is an error; units without spikes make no link.
    """
    at = F.broadcast(channels.select(F.col("channel").alias("anchor"), "x", "y", "shank"))  # a row per contact
    placed = models.join(at, "anchor").withColumn("id", F.struct("day_index", "unit"))
    left = placed.where("assigned > 0").select("id", "x", "y", "probe", "shank", (F.col("day_index") + 1).alias("next"))
    right = placed.select("id", "x", "y", "probe", "shank", F.col("day_index").alias("next"))
    near = guarded(within(left, right, radius, ["probe", "shank", "next"]), "left", most)
    of = lambda side, p: models.select("probe", F.struct("day_index", "unit").alias(side), F.col("w").alias(f"{p}w"), F.col("contacts").alias(f"{p}c"), F.col("day").alias(f"{p}day"), F.col("assigned").alias(f"{p}n")).where(F.col(f"{p}n") > 0)
    met = near.join(of("left", "l"), ["probe", "left"]).join(of("right", "r"), ["probe", "right"])
    name = lambda day, unit: F.concat_ws("/", "probe", day, unit.cast("string"))
    return contact_cosines(met).where("score > 0").select("probe", name("lday", F.col("left.unit")).alias("left_id"), name("rday", F.col("right.unit")).alias("right_id"), F.col("score").alias("cosine"), "distance", F.col("ln").alias("left_spikes"), F.col("rn").alias("right_spikes"), F.lit("unresolved").alias("status"))


def unexplained(events: DataFrame, spikes: DataFrame, contacts: DataFrame, radius: int = 60, least_snr: float = 6.0) -> DataFrame:
    """Loud events with no assigned spike on a shared contact within ``radius``: an interval anti-join by buckets.

    events: (row_id, t, channel, snr); spikes: (t, unit); contacts: (owner, kind, contact) for kind 'channel' and 'unit'.
    """
    width = 2 * radius + 1
    b = F.floor(F.col("t") / width)
    kind = lambda k, name: F.broadcast(contacts.where(F.col("kind") == k).select(F.col("owner").alias(name), "contact"))  # noqa: E731  # the probe's and the bank's maps
    loud = events.where(F.col("snr") >= least_snr)
    asked = loud.join(kind("channel", "channel"), "channel").select("row_id", "t", "contact").withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    busy = spikes.join(kind("unit", "unit"), "unit").select(F.col("t").alias("t2"), "contact", F.floor(F.col("t") / width).alias("_b"))
    hit = asked.join(busy, ["contact", "_b"]).where(F.abs(F.col("t") - F.col("t2")) <= radius).select("row_id").distinct()
    return loud.join(hit, "row_id", "left_anti")


def anchored_peaks(events: DataFrame, frames: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Events whose own channel is the loudest of its local ones at their sample, the first on a tie. frames: (t, channel, v); channel_map: (channel, slot, contact)."""
    near = events.join(F.broadcast(channel_map), "channel").select("row_id", "t", F.col("channel").alias("own"), "slot", F.col("contact").alias("channel"))
    loud = near.join(frames, ["t", "channel"]).groupBy("row_id").agg(F.max_by("slot", F.struct(F.abs("v"), -F.col("slot"))).alias("_s"))
    return events.join(loud.where("_s = 0"), "row_id", "left_semi")


def matched_candidates(candidates: DataFrame, spikes: DataFrame) -> DataFrame:
    """Candidates (row_id, sample, channel) with the spike that explains them, the last on several. spikes: (candidate_sample, channel, unit, score, order)."""
    last = spikes.groupBy(F.col("candidate_sample").alias("sample"), "channel").agg(F.max_by(F.struct("unit", "score"), "order").alias("_m"))
    return candidates.join(last, ["sample", "channel"], "left").select("row_id", "sample", "channel", F.coalesce("_m.unit", F.lit(-1)).alias("unit"), F.col("_m.score").alias("score"))


def teaching_events(matches: DataFrame, contacts: DataFrame, radius: int = 60, score: float = 0.9, margin: float = 0.1, amplitude: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Matches of the first pass that are good enough and have no other match on a shared contact within ``radius``.

    matches: (id, t, unit, pass, score, margin, amplitude); contacts: (unit, contact).
    All matches disturb; only good ones teach.
    """
    width = 2 * radius + 1
    b = F.floor(F.col("t") / width)
    good = (F.col("pass") == 0) & (F.col("score") >= score) & (F.col("margin") >= margin) & F.col("amplitude").between(*amplitude)
    on = F.broadcast(contacts)  # the bank's map
    here = matches.where(good).join(on, "unit").select("id", "t", "contact").withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    there = matches.join(on, "unit").select(F.col("id").alias("id2"), F.col("t").alias("t2"), "contact", b.alias("_b"))
    disturbed = here.join(there, ["contact", "_b"]).where((F.col("id") != F.col("id2")) & (F.abs(F.col("t") - F.col("t2")) <= radius)).select("id").distinct()
    return matches.where(good).join(disturbed, "id", "left_anti")


def epoch_isolated(events: DataFrame, patches: DataFrame, length: int) -> DataFrame:
    """Events (row_id, t, channel, epoch) with ``isolated``: no other of their epoch on a joined patch within ``length``, and none at all of another epoch.

    patches: (channel, neighbour), both ways.
    """
    b = F.floor(F.col("t") / (length + 1))
    other = events.select(F.col("row_id").alias("r2"), F.col("t").alias("t2"), F.col("channel").alias("c2"), F.col("epoch").alias("e2"), b.alias("_b"))
    joined = F.broadcast(patches.select("channel", F.col("neighbour").alias("c2"), F.lit(True).alias("_near")))
    met = events.withColumn("_b", F.explode(F.array(b - 1, b, b + 1))).join(other, "_b").where((F.col("row_id") != F.col("r2")) & (F.abs(F.col("t") - F.col("t2")) <= length))
    hit = met.join(joined, ["channel", "c2"], "left").where(F.col("_near") | (F.col("epoch") != F.col("e2"))).select("row_id").distinct().withColumn("_hit", F.lit(True))
    return events.join(hit, "row_id", "left").withColumn("isolated", F.col("_hit").isNull()).drop("_hit")


def interval_of(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Each point's interval (id, start, stop): the first whose stop is above it, and null if it starts later. Intervals are disjoint, ``width`` long at most."""
    b = lambda c: F.floor(c / width)
    spread = intervals.withColumn("_b", F.explode(F.sequence(b(F.col("start")), b(F.col("stop") - 1))))
    p = points.withColumn("_pb", b(F.col("t")))
    met = p.join(spread, (p["_pb"] == spread["_b"]) & (p["t"] >= spread["start"]) & (p["t"] < spread["stop"]), "left")
    return met.drop("_pb", "_b")


def resolved_labels(spikes: DataFrame, links: DataFrame, probe: str) -> DataFrame:
    """Spikes (t, day, shard, unit) with the label probe/day/linked unit. links: (day, shard, unit, linked).

    A unit without a link, and shards of a day whose links differ, are errors.
    """
    differ = links.groupBy("day", "unit").agg(F.countDistinct("linked").alias("n")).where("n > 1")
    if not differ.isEmpty():
        raise ValueError("links of a day differ between its shards")
    one = links.groupBy("day", "unit").agg(F.max("linked").alias("linked"))
    met = spikes.join(one, ["day", "unit"], "left")
    unit = F.when(F.col("linked").isNotNull(), F.col("linked")).otherwise(F.raise_error(F.lit("a spike's unit has no link")).cast("long"))
    return met.select("t", F.concat_ws("/", F.lit(probe), "day", unit.cast("string")).alias("label"))


def shard_spikes(spikes: DataFrame, shards: DataFrame, probe: str, first: int = 0, stop: int | None = None, exported: bool = False) -> DataFrame:
    """Spikes (t, label) of complete shards that meet [first, stop). spikes: (shard, t, unit, export); shards: (shard, day, start, stop, complete)."""
    meets = F.col("stop") > first
    if stop is not None:
        meets = meets & (F.col("start") < stop)
    chosen = shards.where(meets)
    if not shards.where(~F.col("complete")).isEmpty():
        raise ValueError("incomplete shard")
    if chosen.isEmpty():
        raise ValueError("no complete shard in the interval")
    rows = spikes.join(F.broadcast(chosen.select("shard", "day")), "shard")  # a row per shard
    rows = rows.where(F.col("t") >= first)
    rows = rows if stop is None else rows.where(F.col("t") < stop)
    rows = rows.where("export") if exported else rows
    return rows.select("t", F.concat_ws("/", F.lit(probe), "day", F.col("unit").cast("string")).alias("label"))


def remapped(spikes: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Times of a preview, made of windows of a source put end to end, on the source's clock. windows: (preview_start, preview_stop, source_start)."""
    met = interval_of(spikes, windows.select(F.col("preview_start").alias("start"), F.col("preview_stop").alias("stop"), "source_start"), width)
    return met.where(F.col("start").isNotNull()).select("row_id", (F.col("t") - F.col("start") + F.col("source_start")).alias("t"))


def gathered_features(spikes: DataFrame, channel_map: DataFrame) -> DataFrame:
    """(row_id, channel, value): each spike's local features on the channels they stand for. spikes: (row_id, channel, values); channel_map: (channel, slot, contact)."""
    flat = spikes.select("row_id", "channel", F.posexplode("values").alias("slot", "value"))
    return flat.join(F.broadcast(channel_map), ["channel", "slot"]).select("row_id", F.col("contact").alias("channel"), "value")


def geometry_differs(probe: DataFrame, bank: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Contacts that one side lacks, or that lie further apart than ``tolerance`` on an axis. Both: (channel, x, y)."""
    met = probe.select("channel", F.col("x").alias("px"), F.col("y").alias("py")).join(bank.select("channel", F.col("x").alias("bx"), F.col("y").alias("by")), "channel", "full")
    off = F.greatest(F.abs(F.col("px") - F.col("bx")), F.abs(F.col("py") - F.col("by")))
    return met.where(off.isNull() | (off > tolerance))


def shank_centres(channels: DataFrame) -> DataFrame:
    return channels.groupBy("shank").agg(F.avg("x").alias("x"), F.min("y").alias("lowest"), F.max("y").alias("highest"), F.count("*").alias("contacts"))


def depth_axis(channels: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The axis with the most distinct positions, then the widest span, then the first: one row (axis, positions, span)."""
    told = channels.agg(F.array(*[F.struct(F.countDistinct(a).alias("positions"), (F.max(a) - F.min(a)).cast("double").alias("span"), F.lit(-i).alias("turn"), F.lit(a).alias("axis")) for i, a in enumerate(axes)]).alias("a"))
    best = F.array_max("a")
    return told.select(best["axis"].alias("axis"), best["positions"].alias("positions"), best["span"].alias("span"))


def canonical(templates: DataFrame, times: int = 16, peak: int = 8) -> DataFrame:
    """(unit, contacts, w, moved) with the loudest contact in slot 0 and its largest sample at ``peak``; zeros fill what is moved in.

    templates: (unit, contacts, w), w flat, sample by sample.
    """
    told = templates.withColumn("_big", F.array_max(F.transform("w", lambda x, i: F.struct(F.when(F.get("contacts", i % SLOTS) >= 0, F.abs(x)).otherwise(-1.0).alias("v"), (-i).alias("i")))))
    at = -F.col("_big.i")
    told = told.withColumn("_slot", (at % SLOTS).cast("int")).withColumn("_shift", (peak - F.floor(at / SLOTS)).cast("int"))
    order = F.concat(F.array(F.col("_slot")), F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: s != F.col("_slot")))
    told = told.withColumn("_order", order)
    value = lambda t: F.transform("_order", lambda s: F.when((t - F.col("_shift") >= 0) & (t - F.col("_shift") < times), F.get("w", (t - F.col("_shift")) * SLOTS + s)).otherwise(0.0))
    w = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), value))
    return told.select("unit", F.transform("_order", lambda s: F.get("contacts", s)).alias("contacts"), w.alias("w"), ((F.col("_slot") != 0) | (F.col("_shift") != 0)).alias("moved"))


def energy_masked(templates: DataFrame, fraction: float) -> DataFrame:
    """Slots that aren't needed for ``fraction`` of a template's energy go, loudest first kept; slot 0 always stays."""
    per = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.struct((-F.when(F.get("contacts", s) >= 0, F.aggregate(F.filter("w", lambda x, i: i % SLOTS == s), F.lit(0.0), lambda a, x: a + x * x)).otherwise(0.0)).alias("e"), s.alias("s")))
    told = templates.withColumn("_e", F.array_sort(per)).withColumn("_all", F.aggregate("_e", F.lit(0.0), lambda a, x: a - x["e"]))
    before = F.transform("_e", lambda x, i: F.struct(x["s"].alias("s"), F.aggregate(F.slice("_e", F.lit(1), i), F.lit(0.0), lambda a, y: a - y["e"]).alias("sum")))
    kept = F.array_union(F.array(F.lit(0)), F.transform(F.filter(before, lambda x: x["sum"] < fraction * F.col("_all")), lambda x: x["s"]))
    told = told.withColumn("_k", kept)
    return told.select("unit", F.transform("contacts", lambda c, i: F.when(F.array_contains("_k", i), c).otherwise(-1)).alias("contacts"), F.transform("w", lambda x, i: F.when(F.array_contains("_k", i % SLOTS), x).otherwise(0.0)).alias("w"))


def low_rank(templates: DataFrame, rank: int) -> DataFrame:
    """(unit, w): each template by its ``rank`` strongest separable parts."""
    @F.pandas_udf("array<double>")
    def cut(w: pd.Series) -> pd.Series:
        if not len(w):
            return pd.Series([], dtype=object)
        u, s, v = np.linalg.svd(np.stack(w.to_list()).reshape(len(w), -1, SLOTS), full_matrices=False)
        return pd.Series(list(((u[:, :, :rank] * s[:, None, :rank]) @ v[:, :rank]).reshape(len(w), -1)))

    return templates.withColumn("w", cut("w"))


def latest_models(models: DataFrame, bounds: DataFrame, step: int) -> DataFrame:
    """For each bound the model of the greatest stop not after it, by buckets of time: (bound, model).

    Each bucket's last model is carried on over the buckets, which are few; inside
    a bucket bounds meet its own models only. models: (stop, model).
    """
    b = lambda c: F.floor(F.col(c) / step)
    last = models.groupBy(b("stop").alias("_b")).agg(F.max(F.struct("stop", "model")).alias("_last"))
    ends = last.select("_b", F.lead("_b").over(Window.orderBy("_b")).alias("_to"), "_last")  # a row per bucket
    asked = bounds.select("bound").distinct().withColumn("_b", b("bound"))
    own = asked.join(models.withColumn("_b", b("stop")), "_b").where("stop <= bound").groupBy("bound").agg(F.max(F.struct("stop", "model")).alias("_own"))
    carried = asked.join(F.broadcast(ends), (asked["_b"] > ends["_b"]) & (F.coalesce(asked["_b"] <= ends["_to"], F.lit(True))), "left").select("bound", "_last")
    return asked.join(own, "bound", "left").join(carried, "bound", "left").select("bound", F.coalesce("_own.model", "_last.model").alias("model"))


def refractory_kept(proposals: DataFrame, distance: int) -> DataFrame:
    """Proposals (unit, t, gain, id) that stay if a unit's best first push out all of its others within ``distance``.

    Runs of a unit's times with gaps of at most ``distance`` don't touch each
    other, so each run is a group of its own, not each unit.
    """
    order = Window.partitionBy("unit").orderBy("t", "id")
    run = F.sum(F.when(F.col("t") - F.lag("t").over(order) <= distance, 0).otherwise(1)).over(order)
    rows = proposals.withColumn("_run", run)

    def keep(x: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        good = []
        for r in x.sort_values(["gain", "t", "id"], ascending=[False, True, True]).itertuples(index=False):
            if all(abs(r.t - t) > distance for t in taken):
                taken.append(r.t)
                good.append(r.id)
        return x[x["id"].isin(good)].drop(columns="_run")

    sized = rows.withColumn("_n", F.count("*").over(Window.partitionBy("unit", "_run")))
    alone = sized.where("_n = 1").select(*proposals.columns)
    crowd = sized.where("_n > 1").drop("_n").groupBy("unit", "_run").applyInPandas(keep, proposals.schema)
    return alone.unionByName(crowd)


def failure_classes(traces: DataFrame, floor: float, score_floor: float, tolerance: int) -> DataFrame:
    """Why each target spike was missed, by the furthest that any of its candidates came.

    traces: (target, unit, sample, max_snr, winner, decision, fitted, inside, eligible, score), a row per candidate, or one with a null decision.
    """
    mine = F.col("winner") == F.col("unit")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    near = mine & (F.col("decision") == "accepted") & (F.abs(F.col("fitted") - F.col("sample")) <= tolerance)
    told = traces.groupBy("target").agg(
        any_(near).alias("accepted"), any_(near & F.col("inside")).alias("inside"), any_(mine & (F.col("decision") == "overlap_deferred")).alias("deferred"), any_(mine & (F.col("decision") == "refractory")).alias("refractory"),
        any_(mine & (F.col("decision") == "ambiguity_rejected")).alias("ambiguous"), any_(mine & (F.col("decision") == "gain_rejected")).alias("gain"), any_(F.col("eligible")).alias("eligible"),
        any_(F.col("decision").isNotNull()).alias("rows"), any_(F.col("score") >= score_floor).alias("shaped"), F.max("max_snr").alias("loudest"),
    )
    why = F.when(F.col("accepted") & F.col("inside"), "accepted_nearby_despite_one_to_one_miss").when(F.col("accepted"), "fitted_peak_outside_evaluated_core")
    for name, c in (("overlap_deferred_without_recovery", "deferred"), ("refractory_suppressed", "refractory"), ("expected_winner_but_ambiguous", "ambiguous"), ("expected_winner_low_gain", "gain"), ("expected_eligible_other_template_wins", "eligible")):
        why = why.when(F.col(c), name)
    why = why.when(F.col("rows") & F.col("shaped"), "expected_template_amplitude_rejected").when(F.col("rows"), "expected_template_shape_rejected")
    why = why.when(F.col("loudest") <= floor, "no_candidate_below_threshold_or_masked").otherwise("no_candidate_in_mapped_patch_time_window")
    return told.select("target", why.alias("classification"))
