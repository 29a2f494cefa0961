"""Shards of even row counts that keep equal texts together (operator 8).

Balanced label propagation over the graph whose links join documents of equal
text. Each group is a clique and its members are alike, so their labels are held
as one array per group: how many of its members are in which shard. A round is

1. a histogram of wishes: each group's members want to be where most of it is;
   rows by (from, to, bin), a bin being a gain and a hash, are summed and met on
   the driver, whose table is bounded by shards and bins;
2. quotas: of the wishes as many are let through as leave every shard within its
   room. Wishes that cancel out along a cycle of shards need no room at all, so
   full shards still trade; the others use up the room that is left;
3. moves: a narrow rewriting of the arrays, the greatest gains first. Where a
   quota ends inside a bin, each group moves its share of it, rounded down.

Every move joins members to a part of their group at least as large as their
own, so the number of linked pairs inside shards only grows; rounds end when
under ``SETTLED`` of the linked rows would move.

The law is ``rows``: shard sizes differ by one row at most, whatever the rounds
did. A group of over 1/GIANT of a shard is laid into the shards before the
rounds, whole or filling one after the other; there are under shards * GIANT of
them. Fragments that a shard has no room for, the smallest first, and documents
without links fill what is left free, so sizes are exact.

Ranks inside hot groups and shards are made of a bucket's base, a prefix sum over
few buckets, and a rank inside the bucket, so no task sees a whole group.

Edge cases: null texts are empty and equal to each other; null ids and repeated
rows are rows like others, equal ones in any order; ties between shards fall to
a hash of the group; texts are only hashed, so their length doesn't matter; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_held, text_of, written

SHARDS = 24
BUCKETS, BINS = 512, 64
GIANT = 4
SETTLED = 0.001


def ranked(rows: DataFrame, key: str, parts: int | Column, name: str = "rank") -> DataFrame:
    """Adds the rank of each row among those with an equal ``key``, from 0 and gapless, by a hash and then (tie, doc_id).

    ``parts``: into how many buckets the rows of a key are dealt by the hash. Only
    keys with more than one have bases, and only hot keys have more than one, so
    the bases are few and go by broadcast.
    """
    rows = rows.withColumn("__parts", F.lit(parts).cast("long")).withColumn("__bucket", F.pmod(F.xxhash64("tie", F.lit(2)), F.col("__parts")))
    sums = rows.where("__parts > 1").groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(sums.select(key, "__bucket", F.sum("__n").over(order).alias("__base")))
    inner = Window.partitionBy(key, "__bucket").orderBy("tie", "doc_id")
    placed = rows.withColumn("__in", F.row_number().over(inner) - 1)
    return placed.join(bases, [key, "__bucket"], "left").withColumn(name, F.coalesce("__base", F.lit(0)) + F.col("__in")).drop("__parts", "__bucket", "__base", "__in")


def _interval(bounds: list[int], rank: Column) -> Column:
    """The index i with bounds[i] <= rank < bounds[i + 1]."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[1:]]), lambda b: b <= rank))


def admitted(wishes: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Of wishes[i, j] rows from shard i to j, how many may go such that no shard takes in more than it lets out and has free.

    Cycles of wishes are let through, the shortest first, each up to its
    smallest wish. What is free is one more node: a shard may pass rows on to it
    up to its free room, and from there a cycle goes on to any shard.
    """
    n = len(wishes)
    rest = np.zeros((n + 1, n + 1), np.int64)
    rest[:n, :n] = wishes
    rest[:n, n] = free
    rest[n, :n] = wishes.sum()
    np.fill_diagonal(rest, 0)

    def cycle(start: int) -> list[int] | None:
        queue = np.flatnonzero(rest[start, :n]).tolist()  # a wish comes first
        came = dict.fromkeys(queue, start)
        for x in queue:
            if rest[x, start] > 0:
                path = [x]
                while path[-1] != start:
                    path.append(came[path[-1]])
                return path[::-1]
            for y in np.flatnonzero(rest[x]).tolist():
                if y != start and y not in came:
                    came[y] = x
                    queue.append(y)
        return None

    while True:
        found = [c for i in range(n) if rest[i, :n].any() and (c := cycle(i))]
        if not found:
            return wishes - rest[:n, :n]
        path = min(found, key=len)
        steps = list(zip(path, path[1:] + path[:1], strict=True))
        least = min(rest[a, b] for a, b in steps)
        for a, b in steps:
            rest[a, b] -= least
            if a == n:  # who passes rows on without taking any in has more free
                rest[b, n] += least


def limits(bins: np.ndarray, rows: np.ndarray, quota: int) -> tuple[int, int, int]:
    """(edge, rest, n): bins below ``edge`` go whole, of the n rows in it ``rest`` may go. bins ascend."""
    after = np.cumsum(rows)
    at = int(np.searchsorted(after, quota, side="right"))
    if at == len(bins):
        return (1 << 30), 0, 1
    return int(bins[at]), int(quota - (after[at] - rows[at])), int(rows[at])


def _at(values: Column, s: Column) -> Column:
    return F.element_at(values, s + 1)


def _moved(state: DataFrame, table: list[tuple[int, list[tuple[int, int, int]]]], bins: Column, up: bool) -> DataFrame:
    """Adds goes, how many members of each group leave each shard: by ``table``, the limits for each shard by where the group goes (``to``)."""
    spark = state.sparkSession
    few = spark.createDataFrame(table, "to int, limits array<struct<edge:int,rest:long,n:long>>")  # a row per shard
    rounded = F.ceil if up else F.floor

    def goes(s: Column) -> Column:
        c, b, limit = _at(F.col("c"), s), _at(F.col("bins"), s), _at(F.col("limits"), s)
        part = rounded(c * limit["rest"] / limit["n"]).cast("long")
        return F.when((c == 0) | (s == F.col("to")) | (b > limit["edge"]), F.lit(0).cast("long")).when(b < limit["edge"], c).otherwise(F.least(c, part))

    return state.withColumn("bins", bins).join(F.broadcast(few), "to").withColumn("goes", F.transform(_shards(len(table)), goes))


def _shards(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _sums(state: DataFrame, n: int, *keys: Column):
    """Rows by shard, where they wish to be, and bin: a bounded table."""
    flat = state.select("to", F.explode(F.arrays_zip(_shards(n).alias("shard"), F.col("c").alias("c"), F.col("bins").alias("bin"))).alias("x")).where("x.c > 0")
    found = flat.groupBy(F.col("x.shard").alias("shard"), "to", F.when(F.col("x.shard") == F.col("to"), 0).otherwise(F.col("x.bin")).alias("bin")).agg(F.sum("x.c").alias("n")).toArrow().sort_by("bin")
    return tuple(found.column(c).to_numpy() for c in ("shard", "to", "bin", "n"))


def _log2(x: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(x, F.lit(1)))), F.lit(30))


def propagate(state: DataFrame, room: list[int], settled: float = SETTLED) -> DataFrame:
    """state: (g, members, c), c[s] members of group g in shard s. The state after propagation; shards may hold more than ``room`` if they did at first."""
    n, step, before = len(room), 0, None
    while True:
        here = _shards(n)
        best = F.array_max(F.transform(here, lambda s: F.struct(_at(F.col("c"), s).alias("c"), F.xxhash64(F.col("g"), s, F.lit(step)).alias("h"), s.alias("s"))))  # noqa: B023
        of = state.withColumn("to", best["s"])
        bins = F.transform(here, lambda s: (30 - _log2(_at(F.col("c"), F.col("to")) - _at(F.col("c"), s) + 1)).cast("int") * BINS + F.pmod(F.xxhash64(F.col("g"), F.lit(step), F.lit(9)), F.lit(BINS)).cast("int"))  # noqa: B023
        shard, to, bin_, rows = _sums(of.withColumn("bins", bins), n)
        wishes, total = np.zeros((n, n), np.int64), int(rows.sum())
        np.add.at(wishes, (shard, to), rows)
        there = int(np.trace(wishes))
        if before is not None and there - before < max(1, settled * total):
            return state
        free = np.maximum(np.array(room) - wishes.sum(axis=1), 0)
        np.fill_diagonal(wishes, 0)
        may = admitted(wishes, free)
        if not may.any():
            return state
        table = []
        for t in range(n):
            mine = [(to == t) & (shard == s) for s in range(n)]
            table.append((t, [limits(bin_[m], rows[m], int(may[s, t])) for s, m in enumerate(mine)]))
        moved = _moved(of, table, bins, False)
        gains = F.aggregate("goes", F.lit(0).cast("long"), lambda a, x: a + x)
        after = F.transform(here, lambda s: F.when(s == F.col("to"), _at(F.col("c"), s) + gains).otherwise(_at(F.col("c"), s) - _at(F.col("goes"), s)))
        state = written(moved.select("g", "members", after.alias("c")), "labels")
        before, step = there, step + 1


def within_room(state: DataFrame, room: list[int]) -> DataFrame:
    """Takes members out of shards that hold more than their room, from the smallest fragments first; they belong nowhere then."""
    n = len(room)
    bins = F.transform("c", lambda c: _log2(c).cast("int") * BINS + F.pmod(F.xxhash64(F.col("g"), F.lit(5)), F.lit(BINS)).cast("int"))
    of = state.withColumn("to", F.lit(-1))
    shard, _, bin_, rows = _sums(of.withColumn("bins", bins), n)
    over = [int(rows[shard == s].sum()) - room[s] for s in range(n)]
    if max(over) <= 0:
        return state
    table = [(-1, [limits(bin_[shard == s], rows[shard == s], over[s]) if over[s] > 0 else (-1, 0, 1) for s in range(n)])]
    spark = state.sparkSession
    few = F.broadcast(spark.createDataFrame(table, "to int, limits array<struct<edge:int,rest:long,n:long>>"))

    def stays(s: Column) -> Column:
        c, b, limit = _at(F.col("c"), s), _at(F.col("bins"), s), _at(F.col("limits"), s)
        return F.when(b < limit["edge"], F.lit(0).cast("long")).when(b > limit["edge"], c).otherwise(c - F.least(c, F.ceil(c * limit["rest"] / limit["n"]).cast("long")))

    met = of.withColumn("bins", bins).join(few, "to")
    return written(met.select("g", "members", F.transform(_shards(n), stays).alias("c")), "labels")


def lay_giants(giants: list[tuple[int, int]], room: list[int]) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """(g, members) of few large groups, the largest first, into the emptiest shards one after the other. State rows, and the room that is left."""
    left, out = list(room), []
    for g, members in sorted(giants, key=lambda x: (-x[1], x[0])):
        c, rest = [0] * len(room), members
        while rest:
            s = max(range(len(left)), key=lambda i: (left[i], -i))
            c[s] = min(rest, left[s])
            left[s] -= c[s]
            rest -= c[s]
        out.append((g, members, c))
    return out, left


def first_labels(groups: DataFrame, room: list[int]) -> DataFrame:
    """(g, members, c): each group's members spread evenly over the shards' room, from a place that a hash tells."""
    ends = np.cumsum([0, *room]) / max(sum(room), 1)
    phase = F.pmod(F.xxhash64("g", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    below = F.transform(F.array(*[F.lit(float(x)) for x in ends[:-1]], F.lit(1.0)), lambda x: F.greatest(F.ceil(x * F.col("members") - phase), F.lit(0)).cast("long"))
    spread = groups.withColumn("below", below)
    return spread.select("g", "members", F.transform(_shards(len(room)), lambda s: F.element_at("below", s + 2) - F.element_at("below", s + 1)).alias("c"))


def shard_documents(df: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark, text = df.sparkSession, text_of(text_column)
    rows = df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit(11)).alias("tie"),
    )
    rows = written(rows, "rows")
    groups = written(rows.groupBy("g").agg(F.count("*").alias("members")), "groups")
    total = groups.agg(F.sum("members")).first()[0] or 0
    room = [total // shards + (s < total % shards) for s in range(shards)]
    large = (F.col("members") > 1) & (F.col("members") * (shards * GIANT) > F.lit(total))
    giants, left = lay_giants([(r.g, r.members) for r in groups.where(large).collect()], room)  # under shards * GIANT
    linked = groups.where((F.col("members") > 1) & ~large)
    state = within_room(propagate(written(first_labels(linked, left), "labels"), left), left)
    state = state.unionByName(spark.createDataFrame(giants, "g long, members long, c array<long>"))
    held = [r.c or 0 for r in state.select(F.posexplode("c").alias("s", "c")).groupBy("s").agg(F.sum("c").alias("c")).orderBy("s").collect()] or [0] * shards  # a row per shard
    alone = groups.where("members = 1").withColumn("c", F.lit(None).cast("array<long>"))
    met = join_held(rows, state.unionByName(alone), "g", "members")
    # members of a group in order of rank: its shards' shares one after the other, and who is left belongs nowhere
    parts = F.ceil(F.col("members") * HOT_SHARE / max(total, 1)).cast("long")
    inner = ranked(met.where("members > 1"), "g", parts)
    at = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("shard")), lambda a, c: F.struct((a["sum"] + c).alias("sum"), (a["i"] + 1).alias("i"), F.when((F.col("rank") >= a["sum"]) & (F.col("rank") < a["sum"] + c), a["i"]).otherwise(a["shard"]).alias("shard")))["shard"]
    named = ["doc_id", "size", "text_crc32", "tie"]
    placed = written(inner.select(*named, at.alias("shard")).unionByName(met.where("members = 1").select(*named, F.lit(-1).alias("shard"))), "placed")
    bounds = [0]
    for s in range(shards):
        bounds.append(bounds[-1] + room[s] - held[s])
    every = max(BUCKETS, total // 200_000)
    filled = ranked(placed.where("shard < 0").withColumn("all", F.lit(0)), "all", every).select(*named, _interval(bounds, F.col("rank")).alias("shard"))
    slots = ranked(placed.where("shard >= 0").unionByName(filled), "shard", max(2, every // shards), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("int").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
