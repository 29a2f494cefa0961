"""Models that change over time: promotion on held-out cores, splits of units, proposals for unknown shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learning import heldout_refinement
from .templates import shifted_match

RECENT, BUDGET = 64, 32768


def recent_evidence(evidence: DataFrame, now: int, horizon: int, units: int) -> DataFrame:
    """Each unit's latest snippets (unit, sample, core, w) within the horizon; the queues share one budget. Of one sample's rows the first core's counts."""
    most = min(RECENT, BUDGET // max(units, 1))
    once = evidence.where(F.col("sample") >= now - horizon).withColumn("_d", F.row_number().over(Window.partitionBy("unit", "sample").orderBy("core"))).where("_d = 1")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("sample")))).where(F.col("_r") <= most).drop("_d", "_r")


def _split_at(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_cores`` and ``_held``: the last third of a group's cores is held out whole, the first never."""
    cores = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("core")).alias("_all"))  # groups are bounded queues
    at = F.greatest(F.lit(1), F.floor(2 * F.size("_all") / 3)).cast("int") + 1
    cut = cores.select(*keys, F.size("_all").alias("_cores"), F.try_element_at("_all", at).alias("_cut"))
    return rows.join(cut, keys).withColumn("_held", F.coalesce(F.col("core") >= F.col("_cut"), F.lit(False)))


def promote(models: DataFrame, evidence: DataFrame, last: DataFrame) -> DataFrame:
    """Models (unit, w) moved by a twentieth towards their evidence's median, where later cores confirm it.

    ``last`` (unit, promoted_at) gives the sample of each unit's last promotion.
    At least 16 snippets, 8 of them new, of 2 cores, and 4 on either side of the
    cut. A row per unit with evidence: (unit, support, reason, training_count,
    validation_count, relative_change, validation_gain).
    """
    rows = _split_at(evidence, ["unit"]).join(last, "unit", "left")
    new = F.col("sample") > F.coalesce("promoted_at", F.lit(-1))
    support = rows.groupBy("unit").agg(F.count("*").alias("support"), F.count_if(new).alias("_new"), F.max("_cores").alias("_c"))
    judged = heldout_refinement(models, rows.where("not _held"), rows.where("_held"), 0.05, (4, 4, 1))
    few = (F.col("support") < 16) | (F.col("_new") < 8) | (F.col("_c") < 2)
    reason = F.when(few, "insufficient_independent_evidence").when(F.col("reason") == "insufficient_evidence", "insufficient_temporal_holdout").otherwise(F.col("reason"))
    shown = lambda c: F.when(~few, F.col(c)).alias(c)
    return support.join(judged, "unit").select("unit", "support", reason.alias("reason"), "training_count", "validation_count", shown("relative_change"), shown("validation_gain"))


def halves(z: np.ndarray, rounds: int = 12, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two means of the rows of z, begun at the ends of its first direction, and for each row whether it is beyond the plane midway to the second."""
    pair = z[[z[:, 0].argmin(), z[:, 0].argmax()]]
    for turn in range(rounds):
        beyond = behind(z, pair)
        if not least <= beyond.sum() <= len(z) - least or turn == rounds - 1:
            break
        pair = np.array([z[~beyond].mean(axis=0), z[beyond].mean(axis=0)])
    return pair, beyond


def behind(z: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (z - pair.mean(axis=0)) @ (pair[1] - pair[0]) > 0


def shape_measures(old: np.ndarray, w: np.ndarray, core: np.ndarray, held: np.ndarray, centre: slice) -> dict:
    """What tells whether a unit's snippets (n, time, slot) have two shapes. Directions and means come from those that aren't held out."""
    told: dict = {"training_count": int((~held).sum()), "validation_count": int(held.sum())}
    if min(told.values()) < 2:
        return told
    line = w[:, centre].reshape(len(w), -1)
    line = line - line[~held].mean(axis=0)
    power, axes = np.linalg.eigh(line[~held].T @ line[~held])
    told["spread"] = float(np.sqrt(max(power[-1], 0)))
    if told["spread"] < 1e-6:
        return told
    z = line @ axes[:, :-4:-1]
    pair, _ = halves(z[~held])
    beyond = behind(z, pair)
    parts = [(h, s, held_out & (beyond == s)) for h, held_out in ((0, ~held), (1, held)) for s in (False, True)]
    told |= {name: min(int(m.sum()) for h, _, m in parts if h == k) for k, name in enumerate(("least_trained", "least_held"))}
    told["least_cores"] = min(len(np.unique(core[m])) for _, _, m in parts)
    if not told["least_trained"]:
        return told
    children = np.array([np.median(w[m], axis=0) for h, _, m in parts if h == 0])
    scatter = z[~held] - pair[beyond[~held].astype(int)]
    told["separation"] = float(np.linalg.norm(pair[1] - pair[0]) / max(np.sqrt((scatter**2).sum(axis=1).mean()), 1e-9))
    before, after = ((w[held] - old) ** 2).mean(), ((w[held] - children[beyond[held].astype(int)]) ** 2).mean()
    told["validation_gain"] = float(1 - after / max(before, 1e-9))
    told["child_similarity"] = float(np.vdot(*children) / max(np.linalg.norm(children[0]) * np.linalg.norm(children[1]), 1e-9))
    told["aligned"] = bool((np.abs(children).reshape(2, -1).argmax(axis=1) == old.shape[0] // 2 * old.shape[1]).all())
    near = np.linalg.norm((children - old).reshape(2, -1), axis=1)
    told |= {name: children[i].ravel().tolist() for name, i in zip(("parent", "child"), np.argsort(near, kind="stable"), strict=True)}
    return told


#: Why a unit isn't split, the first that holds; limits are fixed values.
SPLIT_GATES = (
    ("insufficient_support", "training_count < 32 or validation_count < 16"),
    ("no_shape_variation", "spread < 1e-6"),
    ("unbalanced_clusters", "least_trained < 12 or least_held < 6"),
    ("temporal_segregation", "least_cores < 2"),
    ("separation_or_holdout_rejected", "separation < 2.5 or validation_gain < 0.1 or child_similarity > 0.98"),
    ("alignment_changed", "not aligned"),
)
FIGURES = ("separation", "validation_gain", "child_similarity")


def pca_splits(models: DataFrame, snippets: DataFrame, times: int, centre: tuple[int, int], most_new: int = 16) -> DataFrame:
    """(unit, training_count, validation_count, reason, separation, validation_gain, child_similarity, parent, child) per unit with snippets.

    ``snippets`` (unit, row, core, held, w) is a sample with a quota per unit and
    window, so a group is bounded; no core may be on both sides. ``parent`` keeps
    the unit's number, ``child`` is to be added; of valid splits those of the least units are made.
    """
    columns = {"unit": "long", "training_count": "long", "validation_count": "long", "spread": "double", "least_trained": "long", "least_held": "long", "least_cores": "long"} | dict.fromkeys(FIGURES, "double") | {"aligned": "boolean", "parent": "array<double>", "child": "array<double>"}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["core", "row"])
        w = np.stack(rows["w"].to_list()).astype(float).reshape(len(rows), times, -1)
        old = np.array(rows["_old"].iloc[0], float).reshape(times, -1)
        held, core = rows["held"].to_numpy(bool), rows["core"].to_numpy()
        if set(core[held]) & set(core[~held]):
            raise ValueError("a core is on both sides")
        told = shape_measures(old, w, core, held, slice(*centre)) | {"unit": rows["unit"].iloc[0]}
        return pd.DataFrame([[told.get(c) for c in columns]], columns=list(columns))

    met = snippets.select("unit", "row", "core", "held", "w").join(models.select("unit", F.col("w").alias("_old")), "unit")
    judged = met.groupBy("unit").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in columns.items()))
    fails = F.coalesce(*[F.when(F.expr(c), F.lit(name)) for name, c in SPLIT_GATES])
    judged = judged.withColumn("reason", F.coalesce(fails, F.lit("validated_pca_split"))).withColumn("_ok", F.col("reason") == "validated_pca_split")
    place = F.row_number().over(Window.partitionBy("_ok").orderBy("unit"))  # a row per unit, 4,096 at most
    judged = judged.withColumn("_made", F.col("_ok") & (place <= most_new))
    early = [name for name, _ in SPLIT_GATES[:4]]
    shown = [F.when(~F.col("reason").isin(early), F.col(c)).alias(c) for c in FIGURES]
    made = [F.when(F.col("_made"), F.col(c)).alias(c) for c in ("parent", "child")]
    return judged.select("unit", "training_count", "validation_count", F.when(F.col("_ok") & ~F.col("_made"), "model_budget").otherwise(F.col("reason")).alias("reason"), *shown, *made)


def proposals(unknown: DataFrame, horizon: int, dead: int, most: int = 4) -> DataFrame:
    """(anchor, proposal, sample, core, w): unexplained snippets (anchor, sample, core, w) by shape.

    In order of time a snippet joins the proposal of its anchor whose first
    snippet it resembles by a cosine of 0.9 or more, if it comes ``dead`` samples
    after its latest; else it opens one, if the anchor has fewer than ``most``.
    Each holds its last 64 snippets within the horizon. Snippets come from a
    sample with a quota per core and anchor, so groups are bounded.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        open_: dict[int, tuple[np.ndarray, list]] = {}
        made = 0
        for r in rows.sort_values(["sample", "core"]).itertuples():
            w = np.asarray(r.w, float)
            size = np.linalg.norm(w)
            if not np.isfinite(size) or size < 1e-6:
                continue
            open_ = {k: (first, [m for m in members if m.sample >= r.sample - horizon]) for k, (first, members) in open_.items() if r.sample - members[-1].sample <= horizon}
            likeness = {k: float(first @ w / size) for k, (first, _) in open_.items()}
            best = max(likeness, key=lambda k: (likeness[k], k), default=None)
            if best is not None and likeness[best] >= 0.9:
                if r.sample > open_[best][1][-1].sample + dead:
                    open_[best][1].append(r)
                    del open_[best][1][:-RECENT]
            elif len(open_) < most:
                open_[made] = (w / size, [r])
                made += 1
        kept = [(rows["anchor"].iloc[0], k, m.sample, m.core, m.w) for k, (_, members) in open_.items() for m in members]
        return pd.DataFrame(kept, columns=["anchor", "proposal", "sample", "core", "w"])

    return unknown.select("anchor", "sample", "core", "w").groupBy("anchor").applyInPandas(run, "anchor long, proposal long, sample long, core long, w array<double>")


def enrolment(members: DataFrame, models: DataFrame, refractory: int, most: int = 8, contacts: DataFrame | None = None) -> DataFrame:
    """(anchor, proposal, support, reason, consistency, likeness, violations, w): which proposals may become units.

    24 snippets of 3 cores; the last third of the cores is held out (12 and 6 at
    least); a tenth of the held-out cosines at most is below 0.9, no model (anchor, w) of the
    anchor is like it by 0.85, and 1 % of the intervals at most is below ``refractory``.
    With ``contacts`` (anchor, contacts), a row per anchor, models of every anchor
    that shares a contact are compared, contact by contact, over five shifts.
    """
    key = ["anchor", "proposal"]
    rows = _split_at(members, key)
    gap = F.col("sample") - F.lag("sample").over(Window.partitionBy(*key).orderBy("sample"))
    counts = rows.withColumn("_gap", gap).groupBy(*key).agg(F.count("*").alias("support"), F.max("_cores").alias("_c"), F.count_if(~F.col("_held")).alias("_train"), F.count_if("_held").alias("_valid"), F.round(F.avg((F.col("_gap") < refractory).cast("double")), 6).alias("violations"))
    median = rows.where("not _held").select(*key, F.posexplode("w").alias("i", "v")).groupBy(*key, "i").agg(F.median("v").alias("v"))
    shape = median.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("w"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda a, b: product(a, b) / F.greatest(F.sqrt(product(a, a) * product(b, b)), F.lit(1e-12))
    held = rows.where("_held").select(*key, F.col("w").alias("_h")).join(shape, key)
    agree = held.groupBy(*key).agg(F.round(F.percentile(cosine(F.col("w"), F.col("_h")), 0.1), 6).alias("consistency"))
    like = shape.join(models.select("anchor", F.col("w").alias("_m")), "anchor").groupBy(*key).agg(F.round(F.max(cosine(F.col("w"), F.col("_m"))), 6).alias("likeness"))
    if contacts is not None:
        at = F.broadcast(contacts)
        a = shape.join(at, "anchor").select(*key, F.col("w").alias("lw"), F.col("contacts").alias("lc"), F.explode("contacts").alias("_on"))
        b = models.join(at, "anchor").select(F.xxhash64("anchor", "w").alias("_id"), F.col("w").alias("rw"), F.col("contacts").alias("rc"), F.explode("contacts").alias("_on")).where("_on >= 0")
        met = a.join(b, "_on").dropDuplicates([*key, "_id"])
        like = met.withColumn("_s", shifted_match(F.col("lw"), F.col("lc"), F.col("rw"), F.col("rc"), share=0.0, whole=True)["score"]).groupBy(*key).agg(F.round(F.max("_s"), 6).alias("likeness"))
    full = counts.join(shape, key, "left").join(agree, key, "left").join(like, key, "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))
    refused = (F.col("consistency") < 0.9) | (F.col("likeness") >= 0.85) | (F.col("violations") > 0.01)
    reason = F.when((F.col("support") < 24) | (F.col("_c") < 3), "insufficient_temporal_support").when((F.col("_train") < 12) | (F.col("_valid") < 6), "insufficient_holdout").when(refused, "consistency_duplicate_or_refractory_rejected").otherwise("enrolled")
    full = full.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("reason").orderBy(*key))  # a row per proposal
    return full.withColumn("_p", place).select(*key, "support", F.when((F.col("reason") == "enrolled") & (F.col("_p") > most), "active_model_budget").otherwise(F.col("reason")).alias("reason"), "consistency", "likeness", "violations", "w")
