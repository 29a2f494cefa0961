"""Scoring against ground truth, and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, EDGES = 20_000, 500_000  # of a block of time, of a task that adds up


def interval_pairs(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Rows of both sides at most ``tolerance`` apart: a range join by buckets of time.

    left: (t, label), right: (t, label); the result has (t, label, t2, label2).
    """
    width = max(1, tolerance)
    b = F.floor(F.col("t") / width)
    a = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    c = right.select(F.col("t").alias("t2"), F.col("label").alias("label2"), b.alias("_b"))
    return a.join(c, "_b").where(F.abs(F.col("t") - F.col("t2")) <= tolerance).drop("_b")


def inside_spans(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Points in any of the half-open spans (start, stop), which are ``width`` long at most."""
    b = lambda c: F.floor(F.col(c) / width)
    s = spans.withColumn("_b", F.explode(F.sequence(b("start"), b("stop"))))
    p = points.withColumn("_pb", b("t"))
    return p.join(s, (p["_pb"] == s["_b"]) & (p["t"] >= s["start"]) & (p["t"] < s["stop"]), "left_semi").drop("_pb")


def collisions(points: DataFrame, tolerance: int) -> DataFrame:
    """Neighbours in time order, at most ``tolerance`` apart, of different labels.

    Neighbours across partitions of time are found from each block's last row.
    """
    block = F.floor(F.col("t") / 86400)
    order = Window.partitionBy("_b").orderBy("t", "label")
    rows = points.withColumn("_b", block).withColumn("_pt", F.lag("t").over(order)).withColumn("_pl", F.lag("label").over(order))
    last = rows.groupBy("_b").agg(F.max(F.struct("t", "label")).alias("_last"))
    before = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_before"))
    full = rows.join(F.broadcast(before), "_b").withColumn("_pt", F.coalesce("_pt", "_before.t")).withColumn("_pl", F.coalesce("_pl", "_before.label"))
    return full.where((F.col("t") - F.col("_pt") <= tolerance) & (F.col("label") != F.col("_pl"))).select("t", "label", F.col("_pt").alias("before_t"), F.col("_pl").alias("before_label"))


def two_pointer(left: np.ndarray, right: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy one-to-one matching of two sorted lists, earliest first."""
    i = j = 0
    a, b = [], []
    while i < len(left) and j < len(right):
        d = left[i] - right[j]
        if abs(d) <= tolerance:
            a.append(i)
            b.append(j)
            i += 1
            j += 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return np.array(a, int), np.array(b, int)


def edges_within(t1: np.ndarray, t2: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of two sorted lists at most ``tolerance`` apart."""
    a, b = np.searchsorted(t2, t1 - tolerance), np.searchsorted(t2, t1 + tolerance, "right")
    n = b - a
    return np.repeat(np.arange(len(t1)), n), np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)


def edge_groups(label: np.ndarray, label2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of edges, and where groups start in it: edges of a pair of labels, cut where none reaches over. Groups match independently."""
    order = np.lexsort((low, label2, label))
    a, b, low, high = label[order], label2[order], low[order] - low.min(), high[order] - low.min()
    pair = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(pair + high)
    return order, np.flatnonzero(np.append(True, (pair + low)[1:] > reach[:-1]))


def group_matches(x: np.ndarray, n1: np.ndarray, y: np.ndarray, n2: np.ndarray, starts: np.ndarray, tolerance: int) -> np.ndarray:
    """How many of a group's events match one to one, earliest first as by ``two_pointer``; x and y stand for n1 and n2 events."""
    out, ends = np.minimum(n1[starts], n2[starts]), np.append(starts[1:], len(x))
    for g in np.flatnonzero(ends - starts > 1):
        at = slice(starts[g], ends[g])
        left, right = (sorted(dict(zip(t[at].tolist(), n[at].tolist(), strict=True)).items()) for t, n in ((x, n1), (y, n2)))
        i = j = total = 0
        (t, r), (u, q) = left[0], right[0]
        while True:
            if abs(t - u) <= tolerance:
                m = min(r, q)
                total, r, q = total + m, r - m, q - m
            elif t < u:
                r = 0
            else:
                q = 0
            if not r:
                i += 1
                if i == len(left):
                    break
                t, r = left[i]
            if not q:
                j += 1
                if j == len(right):
                    break
                u, q = right[j]
        out[g] = total
    return out


def matched_pairs(truth: DataFrame, predicted: DataFrame, tolerance: int) -> DataFrame:
    """Per pair of labels that ever meet: how many match one to one.

    Blocks of time find who meets whom and count what can't reach out of them;
    of the rest the meetings alone, not the labels' times, go on to a task for each pair.
    """
    both = truth.select(F.lit(0).alias("side"), "t", "label").unionByName(predicted.select(F.lit(1).alias("side"), "t", "label")).where("t is not null and label is not null")
    told = both.agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.min("t").alias("first"), F.max("t").alias("last")).first()  # one row
    span = (told["last"] or 0) - (told["first"] or 0) + 1
    width = int(max(1, 64 * tolerance, span * ROWS // max(1, told["a"] + told["b"])))
    tasks = int(told["a"] * told["b"] * (2 * tolerance + 1) / span / EDGES) + 1
    block = F.floor(F.col("t") / width)
    spread = both.withColumn("block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("t") - tolerance) / width)))))
    kind = "label long, label2 long, matched long, rest struct<x:long,n1:long,y:long,n2:long>"
    empty = pa.schema([("label", pa.int64()), ("label2", pa.int64()), ("matched", pa.int64()), ("rest", pa.struct([(c, pa.int64()) for c in ("x", "n1", "y", "n2")]))])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        start = key[0].as_py() * width
        side, t, label = (np.asarray(rows[c]).astype(np.int64) for c in ("side", "t", "label"))

        def events(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(side == which)
            at = at[np.lexsort((label[at], t[at]))]
            first = np.flatnonzero(np.append(True, (np.diff(t[at]) != 0) | (np.diff(label[at]) != 0))) if len(at) else at
            return t[at][first], label[at][first], np.diff(np.append(first, len(at)))

        (t1, l1, n1), (t2, l2, n2) = events(0), events(1)
        i, j = edges_within(t1, t2, tolerance)
        low = np.minimum(t1[i], t2[j])
        own = (low >= start) & (low < start + width)
        i, j = i[own], j[own]
        if not len(i):
            return empty.empty_table()
        a, b, x, y, n1, n2 = l1[i], l2[j], t1[i], t2[j], n1[i], n2[j]
        order, starts = edge_groups(a, b, np.minimum(x, y), np.maximum(x, y))
        a, b, x, y, n1, n2 = (v[order] for v in (a, b, x, y, n1, n2))
        inside = (np.minimum.reduceat(np.minimum(x, y), starts) >= start + tolerance) & (np.maximum.reduceat(np.maximum(x, y), starts) < start + width)
        size = np.diff(np.append(starts, len(x)))
        closed = np.repeat(inside, size)
        kept = [v[closed] for v in (x, n1, y, n2)]
        begin = np.cumsum(size[inside]) - size[inside]
        done = [a[starts[inside]], b[starts[inside]], group_matches(*kept, begin, tolerance)] if len(begin) else [a[:0]] * 3
        pair = np.lexsort((done[1], done[0]))
        done = summed(*(v[pair] for v in done))
        some, out = ~closed, len(done[0])
        left = [np.append(done[0], a[some]), np.append(done[1], b[some]), np.append(done[2], np.zeros(some.sum(), int))]
        rest = pa.StructArray.from_arrays([pa.array(np.append(np.zeros(out, int), v[some])) for v in (x, n1, y, n2)], ["x", "n1", "y", "n2"], mask=pa.array(np.arange(out + some.sum()) < out))
        return pa.table([*map(pa.array, left), rest], schema=empty)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), empty)
        if not len(whole):
            return
        a, b, n = (np.asarray(whole[c]) for c in ("label", "label2", "matched"))
        rest = pa.concat_arrays(whole["rest"].chunks)
        some = np.flatnonzero(np.asarray(rest.is_valid()))
        if len(some):
            x, n1, y, n2 = (np.asarray(v) for v in rest.take(pa.array(some)).flatten())
            order, starts = edge_groups(a[some], b[some], np.minimum(x, y), np.maximum(x, y))
            n = n.copy()
            n[some[order[starts]]] = group_matches(x[order], n1[order], y[order], n2[order], starts, tolerance)
        pair = np.lexsort((b, a))
        out = summed(a[pair], b[pair], n[pair])
        for at in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000]) for v in out], names=["label", "label2", "matched"])

    found = spread.groupBy("block").applyInArrow(meet, kind)
    tasks = max(tasks, int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "label", "label2").mapInArrow(add, "label long, label2 long, matched long")


def summed(label: np.ndarray, label2: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sums by pair of labels, of rows in their order."""
    if not len(label):
        return [label, label2, n]
    first = np.flatnonzero(np.append(True, (np.diff(label) != 0) | (np.diff(label2) != 0)))
    return [label[first], label2[first], np.add.reduceat(n, first)]


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one assignment of rows to columns, by shortest augmenting paths."""
    n, m = weights.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(weights.T))
    cost = weights.max(initial=0) - weights
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = cost[match[0 if j0 == 0 else j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (row < least[1:])
            least[1:][better], way[1:][better] = row[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def unit_assignment(truth: DataFrame, predicted: DataFrame, tolerance: int) -> DataFrame:
    """Each true unit's predicted unit under the largest total IoU. Units are a few hundred, so their pairs are."""
    pairs = matched_pairs(truth, predicted, tolerance)
    n1, n2 = truth.groupBy("label").agg(F.count("*").alias("n1")), predicted.groupBy(F.col("label").alias("label2")).agg(F.count("*").alias("n2"))
    rows = pairs.join(n1, "label").join(n2, "label2", "inner").withColumn("iou", F.col("matched") / (F.col("n1") + F.col("n2") - F.col("matched")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(batches))
        if not len(p):
            return
        left, right = np.unique(p["label"]), np.unique(p["label2"])
        w = np.zeros((len(left), len(right)))
        w[np.searchsorted(left, p["label"]), np.searchsorted(right, p["label2"])] = p["iou"]
        found = [(left[i], right[j], w[i, j]) for i, j in assignment(w) if w[i, j] > 0]
        yield pd.DataFrame(found, columns=["label", "label2", "iou"])

    return rows.select("label", "label2", "iou").coalesce(1).mapInPandas(solve, "label long, label2 long, iou double")


def split_and_merged(truth: DataFrame, predicted: DataFrame, tolerance: int, share: float = 0.2) -> DataFrame:
    """Per true unit, how many predicted units meet a share of it, and whether it is split or merged."""
    pairs = interval_pairs(truth, predicted, tolerance).groupBy("label", "label2").agg(F.countDistinct("t").alias("n"))
    size = truth.groupBy("label").agg(F.countDistinct("t").alias("size"))
    strong = pairs.join(size, "label").where(F.col("n") >= share * F.col("size"))
    per = strong.withColumn("owners", F.count("*").over(Window.partitionBy("label2")))
    return per.groupBy("label").agg(F.count("*").alias("units"), (F.count("*") >= 2).alias("split"), (F.max("owners") >= 2).alias("merged"))


def isi_violations(points: DataFrame, limit: int) -> DataFrame:
    """Per unit the share of gaps below ``limit``."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("label").orderBy("t"))
    return points.withColumn("_g", gap).groupBy("label").agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("_g") < limit).cast("double")), F.lit(0.0)).alias("violations"))


def isolated(points: DataFrame, limit: int, contact: Column) -> DataFrame:
    """Points with no other on the same contact within ``limit``; neighbours in order suffice."""
    order = Window.partitionBy(contact).orderBy("t", "row_id")
    far = lambda other: F.coalesce(F.abs(F.col("t") - other) > limit, F.lit(True))
    return points.withColumn("_ok", far(F.lag("t").over(order)) & far(F.lead("t").over(order))).where("_ok").drop("_ok")
