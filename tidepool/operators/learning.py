"""Learning of templates from snippets: clusters per anchor, links of duplicates, held-out refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .templates import SLOTS, dot, energy, exploded

LEAST_SNIPPETS, LEAST_MEMBERS, MOST_CLUSTERS, ROUNDS = 20, 10, 4, 8


def spherical_means(snippets: np.ndarray, centre: slice) -> list[np.ndarray]:
    """Row numbers of each cluster: k-means on the sphere, seeded by the largest snippet and then the farthest.

    ``snippets`` is (n, times, slots); only the ``centre`` of the times decides.
    One cluster per 20 snippets, 4 at most; silent snippets and clusters under 10 go.
    """
    flat = snippets[:, centre].reshape(len(snippets), -1)
    size = np.linalg.norm(flat, axis=1)
    loud = np.flatnonzero(size > 1e-6)
    if len(snippets) < LEAST_SNIPPETS or len(loud) < LEAST_MEMBERS:
        return []
    unit = flat[loud] / size[loud, None]
    k = int(np.clip(len(snippets) // LEAST_SNIPPETS, 1, MOST_CLUSTERS))
    means = unit[[size[loud].argmax()]]
    while len(means) < k:
        means = np.vstack([means, unit[(unit @ means.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        owner = (unit @ means.T).argmax(axis=1)
        for j in range(k):
            if (owner == j).any():
                m = unit[owner == j].mean(axis=0)
                means[j] = m / max(np.linalg.norm(m), 1e-6)
    return [loud[owner == j] for j in range(k) if (owner == j).sum() >= LEAST_MEMBERS]


def calibrate(snippets: DataFrame, times: int = 16, centre: tuple[int, int] = (4, 12)) -> DataFrame:
    """(anchor, cluster, n, w): mean snippets of each anchor's clusters.

    ``snippets`` (row_id, anchor, w) comes from a reservoir with a quota per
    anchor, so a group is bounded by that quota.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        w = np.stack(rows["w"].to_list()).reshape(len(rows), times, -1)
        found = spherical_means(w, slice(*centre))
        return pd.DataFrame({"anchor": [rows["anchor"].iloc[0]] * len(found), "cluster": range(len(found)), "n": [len(x) for x in found], "w": pd.Series([w[x].mean(axis=0).ravel() for x in found], dtype=object)})

    return snippets.select("row_id", "anchor", "w").groupBy("anchor").applyInPandas(run, "anchor long, cluster long, n long, w array<double>")


def duplicate_pairs(templates: DataFrame, channels: DataFrame, threshold: float = 0.93, radius: float = 32.0) -> DataFrame:
    """Pairs left < right whose anchors share a shank within ``radius`` and whose signed zero-lag cosine reaches the threshold.

    Contacts that only one of them has count as zeros of the other. The geometry is that of a probe, a few hundred rows.
    """
    a = channels.select(F.col("channel_index").alias("anchor"), "x", "y", "shank")
    b = channels.select(F.col("channel_index").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "shank")
    near = a.join(b, "shank").where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius**2).select("anchor", "other")
    by_contact = exploded(templates).groupBy("unit", "anchor", "contact").agg(F.sort_array(F.collect_list(F.struct((F.floor(F.col("i") / SLOTS)).alias("time"), "value"))).alias("v"))
    waves = by_contact.groupBy("unit", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("contact", F.col("v.value").alias("v")))).alias("m"))
    whole = waves.join(templates.select("unit", energy(F.col("w")).alias("e")), "unit").where("e > 1e-24")
    left = whole.select(F.col("unit").alias("left"), "anchor", F.col("m").alias("ml"), F.col("e").alias("el"))
    right = whole.select(F.col("unit").alias("right"), F.col("anchor").alias("other"), F.col("m").alias("mr"), F.col("e").alias("er"))
    met = left.join(near, "anchor").join(right, "other").where("left < right")
    common = F.array_intersect(F.map_keys("ml"), F.map_keys("mr"))
    both = F.flatten(F.transform(common, lambda c: F.try_element_at("ml", c))), F.flatten(F.transform(common, lambda c: F.try_element_at("mr", c)))
    score = dot(*both) / F.sqrt(F.col("el") * F.col("er"))
    return met.where(F.size(common) > 0).select("left", "right", score.alias("score")).where(F.col("score") >= threshold)


def linked_identities(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, identity): linked units share one, numbered from 0 in order of their least unit.

    The least unit goes along the links until nothing changes; each round is
    checkpointed in the shared folder. The loop sees one count a round.
    """
    context = units.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # only where the cluster names none, as in tests
        context.setCheckpointDir(shared_folder(units.sparkSession))
    links = pairs.select(F.col("left").alias("a"), F.col("right").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    roots = units.select("unit", F.col("unit").alias("root"))
    while True:
        least = links.join(roots.withColumnsRenamed({"unit": "b"}), "b").groupBy(F.col("a").alias("unit")).agg(F.min("root").alias("_r"))
        moved = roots.join(least, "unit", "left").withColumn("_n", F.least("root", "_r")).checkpoint()
        roots = moved.select("unit", F.col("_n").alias("root"))
        if moved.where("_n < root").isEmpty():
            break
    numbers = roots.select("root").distinct().withColumn("identity", (F.row_number().over(Window.orderBy("root")) - 1).cast("long"))  # a row per identity
    return roots.join(numbers, "root").select("unit", "identity")


def heldout_refinement(models: DataFrame, training: DataFrame, validation: DataFrame, blend: float = 0.25, least: tuple[int, int, int] = (12, 6, 2)) -> DataFrame:
    """Whether moving each model (unit, w) towards the median of its training snippets (unit, core, w) helps on held-out ones (unit, w).

    ``least``: snippets to train on, held-out ones, cores to train on; the model may
    change by a tenth, the mean error must fall by 0.5 %, and the 0.9 quantile
    of its rise stay below 5 % of the mean error.
    """
    if not 0 < blend <= 1:
        raise ValueError("blend must be above 0, at most 1")
    seen = training.groupBy("unit").agg(F.count("*").alias("training_count"), F.countDistinct("core").alias("_cores"))
    median = training.select("unit", F.posexplode("w").alias("i", "v")).groupBy("unit", "i").agg(F.median("v").alias("v"))
    target = median.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("_t"))
    moved = models.select("unit", "w").join(target, "unit", "left").withColumn("_p", F.zip_with("w", "_t", lambda w, t: (1 - blend) * w + blend * t))
    apart = lambda a, b: energy(F.zip_with(a, b, lambda x, y: x - y))
    moved = moved.withColumn("relative_change", F.round(F.sqrt(apart("_p", "w")) / F.greatest(F.sqrt(energy(F.col("w"))), F.lit(1e-12)), 6))
    held = validation.select("unit", F.col("w").alias("_v")).join(moved.select("unit", "w", "_p"), "unit")
    errors = held.select("unit", (apart("_v", "w") / F.size("w")).alias("old"), (apart("_v", "_p") / F.size("w")).alias("new"))
    old = F.greatest(F.avg("old"), F.lit(1e-12))
    judged = errors.groupBy("unit").agg(F.count("*").alias("validation_count"), F.round(1 - F.avg("new") / old, 6).alias("validation_gain"), (F.percentile(F.col("new") - F.col("old"), 0.9) > 0.05 * old).alias("_worse"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    full = moved.join(seen, "unit", "left").join(judged, "unit", "left").select("unit", "relative_change", "validation_gain", "_worse", "_cores", count("training_count"), count("validation_count"))
    few = (F.col("training_count") < least[0]) | (F.col("validation_count") < least[1]) | (F.coalesce("_cores", F.lit(0)) < least[2])
    refused = (F.col("relative_change") > 0.1) | (F.col("validation_gain") < 0.005) | F.col("_worse")
    reason = F.when(few, "insufficient_evidence").when(refused, "validation_rejected").otherwise("heldout_waveform_improvement")
    shown = lambda c: F.when(~few, F.col(c)).alias(c)
    return full.select("unit", "training_count", "validation_count", reason.alias("reason"), shown("relative_change"), shown("validation_gain"))
