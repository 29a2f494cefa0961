"""N-gram Jaccard self-join by a MinHash LSH forest (operator 7).

1. A signature of every document: ``TREES`` labels, each of ``DEPTH`` MinHash
   values of ``LANE`` bits packed in one integer, so that sorted labels are the
   leaves of a tree's trie in order and a shorter prefix is a shift. Documents
   with the same set of shingles are one node from here on, with the number of
   its documents.
2. The forest: (tree, label, node) of all nodes, sorted over the cluster by
   ranges, so that a hot prefix lies across as many tasks as it needs. One scan
   finds how long a prefix each entry shares with the one before it and ties it
   to the first node of the run that has this prefix: a row per entry at most,
   from which the runs of every prefix length can be put together.
3. The forest is asked with whole labels first. Connected components of the ties
   become candidate groups, which are verified; every link found at similarity s
   stands for 1 / p(s) links, p(s) being the chance that a pair of that
   similarity meets at this prefix length. If the links found are less than the
   target recall of the links so estimated, the prefixes are shortened by a value
   and the forest is asked again, down to the length at which even pairs at the
   threshold are met with the target's chance.
4. Exact verification: within a candidate group all pairs are compared by their
   shingle sets, in blocks of ``BLOCK`` nodes; a group larger than one block is
   dealt out by pairs of blocks. What leaves a task is a count per node and
   ties that span what it found, never pairs.
5. Components of the verified ties are the classes.

So links between different texts are all counted, hot groups are split, and no
bucket is capped. The work on a candidate group grows with the square of its
distinct nodes; the memory and the rows do not.

Edge cases: null, empty and wordless texts have the empty set and are one node;
texts of any length give their whole sets, in blocks of their own if they are
long; repeated rows count as documents of their own; null ids are kept and can't
name a class unless it has no other id; of equally good rows to keep, equal in id
and text, any one is kept; an empty table gives an empty result. Node names are
64-bit hashes of shingle sets. Other columns are not read by the join, and
``one_of_each_class`` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_held, mapped, release, text_of, written
from .token_counts import BATCH_CHARS, groups_by_size

TREES, DEPTH, LANE = 20, 7, 9
THRESHOLD, RECALL = 0.8, 0.999
BLOCK = 512
#: Shingles of a block, 8 bytes each; so long documents make smaller blocks.
BLOCK_SHINGLES = 500_000
#: Ids of documents to be read again: 8 bytes each, so 4 MB; more are met by a shuffle.
BROADCAST_IDS = 500_000


def expected_recall(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, target: float = RECALL) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    depth = DEPTH
    while depth > 1 and expected_recall(depth, threshold) < target:
        depth -= 1
    return depth


def signatures(rows: DataFrame) -> DataFrame:
    """rows: (doc_id, text, digest). (doc_id, digest, node, n_shingles, labels) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import distinct, mix, shingles

        factors = np.random.default_rng(2).integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_by_size(texts, BATCH_CHARS):
                values, at = distinct(*shingles(texts[a:b]))
                n = np.diff(at)
                some = np.flatnonzero(n)
                node = np.zeros(b - a, np.uint64)
                labels = np.zeros((b - a, TREES), np.uint64)
                if len(some):
                    starts = at[:-1][some]
                    node[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts) + n[some].astype(np.uint64))
                    for t in range(TREES):
                        label = np.zeros(len(some), np.uint64)
                        for d in range(DEPTH):
                            least = np.minimum.reduceat(values * factors[t * DEPTH + d], starts)
                            label = (label << np.uint64(LANE)) | (mix(least) >> np.uint64(64 - LANE))
                        labels[some, t] = label
                flat = pa.array(labels.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(node.view(np.int64)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TREES), flat)], names=["doc_id", "digest", "node", "n_shingles", "labels"])

    return mapped(rows, run, "doc_id long, digest long, node long, n_shingles long, labels array<long>")


def forest(nodes: DataFrame, shortest: int, partitions: int | None = None) -> DataFrame:
    """nodes: (node, labels). (a, b, depth): b shares a prefix of ``depth`` values with a in some tree, the longest it shares with an entry before it.

    Depths from ``shortest`` on. Entries at the borders of ranges are tied on the driver, one pair per range.
    """
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        range_, last = TaskContext.get().partitionId(), None
        heads = {d: 0 for d in range(shortest, DEPTH + 1)}  # of each length the first node of the run that is open

        def told(a, b, depth, tree) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()), pa.array(tree, pa.int32()), pa.array(np.full(len(a), range_), pa.int32())], names=["a", "b", "depth", "tree", "range"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, node = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                yield told(node[:1], label[:1], [-1], tree[:1])
            before_tree, before_label = np.concatenate(([-1 if last is None else last[0]], tree[:-1])), np.concatenate(([0 if last is None else last[1]], label[:-1]))
            alike = sum((((label ^ before_label) >> (LANE * (DEPTH - d))) == 0).astype(np.int8) for d in range(1, DEPTH + 1))
            alike[tree != before_tree] = 0
            for d in range(shortest, DEPTH + 1):
                at = np.maximum.accumulate(np.where(alike < d, np.arange(len(node)), -1))
                head = np.where(at >= 0, node[at], heads[d])
                heads[d] = int(head[-1])
                met = np.flatnonzero(alike == d)
                if len(met):
                    yield told(head[met], node[met], np.full(len(met), d), tree[met])
            last = int(tree[-1]), int(label[-1]), int(node[-1])
        if last is not None:
            yield told([last[2]], [last[1]], [-2], [last[0]])

    flat = nodes.select(F.posexplode("labels").alias("tree", "label"), "node").select(F.col("tree").cast("byte").alias("tree"), "label", "node")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = flat.repartitionByRange(partitions, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = written(mapped(placed, run, "a long, b long, depth int, tree int, range int"), "forest")
    ends = sorted((r.range, r.depth == -2, r.tree, r.b, r.a) for r in found.where("depth < 0").collect())  # two rows a range
    ties = []
    for (_, closing, t1, l1, n1), (_, _, t2, l2, n2) in zip(ends, ends[1:], strict=False):
        if closing and t1 == t2:
            depth = max((d for d in range(1, DEPTH + 1) if (l1 ^ l2) >> (LANE * (DEPTH - d)) == 0), default=0)
            if depth >= shortest:
                ties.append((n1, n2, depth))
    return found.where("depth > 0").select("a", "b", "depth").unionByName(spark.createDataFrame(ties, "a long, b long, depth int"))


def components(ties: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node in ``ties`` (a, b); the component is its least node.

    Alternating large-star and small-star rounds: every round sends each node's
    ties to the least of its neighbours, so long chains halve. Each round is
    written to the shared folder; it ends when a round changes nothing.
    """
    same = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", "a"))).first())
    edges = written(ties.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-ties")
    mark = same(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small-star: each node's smaller neighbours, and itself, move to the least of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("x"), "a", "b")
        after = small.select(F.col("x").alias("a"), "b").unionByName(small.where("a <> x").select(F.col("x").alias("a"), F.col("a").alias("b"))).distinct()
        after = written(after, f"{name}-round")
        before, mark, edges = mark, same(after), after
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def linked(left, right, n_left, n_right, threshold: float):
    """Which sets of one list are similar to which of the other; sets as (values, offsets). A boolean matrix, and the similarities.

    Shared shingles are counted by matrix products over slabs of the shingles
    that at least two of the sets have.
    """
    import numpy as np

    (x, xo), (y, yo) = left, right
    every = np.concatenate([x, y])
    names, code, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    xi, yi = np.repeat(np.arange(len(xo) - 1), np.diff(xo)), np.repeat(np.arange(len(yo) - 1), np.diff(yo))
    keep = (count > 1)[code]
    cx, cy = rank[code[: len(x)]], rank[code[len(x) :]]
    kx, ky = keep[: len(x)], keep[len(x) :]
    xi, cx, yi, cy = xi[kx], cx[kx], yi[ky], cy[ky]
    shared = np.zeros((len(xo) - 1, len(yo) - 1), np.float32)
    total, slab = int(rank[-1]) + 1 if len(rank) else 0, 4096
    ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
    xi, cx, yi, cy = xi[ox], cx[ox], yi[oy], cy[oy]
    for s in range(0, total, slab):
        a, b = np.searchsorted(cx, (s, s + slab))
        c, d = np.searchsorted(cy, (s, s + slab))
        if a == b or c == d:
            continue
        width = min(slab, total - s)
        p, q = np.zeros((len(xo) - 1, width), np.float32), np.zeros((len(yo) - 1, width), np.float32)
        p[xi[a:b], cx[a:b] - s] = 1
        q[yi[c:d], cy[c:d] - s] = 1
        shared += p @ q.T
    either = n_left[:, None] + n_right[None, :] - shared
    return shared >= threshold * either - 1e-6, shared / np.maximum(either, 1)


def _verify(threshold: float, depth: int):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        release()  # what the group before has left
        table = table.combine_chunks()
        node, side, weight = (table.column(c).to_numpy() for c in ("node", "side", "weight"))
        lists = table.column("hashes").chunk(0) if table.num_rows else None
        values, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))

        def of(pick):
            n = (offsets[1:] - offsets[:-1])[pick]
            at = np.repeat(offsets[:-1][pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return (values[at], np.concatenate(([0], np.cumsum(n)))), n.astype(np.float32)

        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        (xs, nx) = of(first)
        itself = table.num_rows and table.column("low")[0] == table.column("high")[0]
        if not itself:
            if not len(first) or not len(second):  # a block that got no node; the other meets itself elsewhere
                return pa.table({c: pa.array([], pa.float64() if c == "stands_for" else pa.int64()) for c in ("node", "links", "tie", "pairs", "stands_for")})
            ys, ny = of(second)
            yes, alike = linked(xs, ys, nx, ny, threshold)
            members = np.concatenate([first, second])
            links = np.concatenate([yes @ weight[second], weight[first] @ yes])
            pairs = np.concatenate([yes.sum(axis=1), yes.sum(axis=0)])
            stands_for = np.where(yes, 1 / expected_recall(depth, np.maximum(alike, threshold / 2)), 0.0)
            stands_for = np.concatenate([stands_for.sum(axis=1), stands_for.sum(axis=0)])
            whole = np.zeros((len(members), len(members)), bool)
            whole[: len(first), len(first) :] = yes
            whole |= whole.T
        else:
            whole, alike = linked(xs, xs, nx, nx, threshold)
            np.fill_diagonal(whole, False)
            members, links, pairs = first, whole @ weight[first], whole.sum(axis=1)
            stands_for = np.where(whole, 1 / expected_recall(depth, np.maximum(alike, threshold / 2)), 0.0).sum(axis=1)
        # ties that span what is linked here: each node to the least node of its component
        names = node[members]
        label = names.copy()
        while True:
            over = np.where(whole, label[None, :], np.iinfo(np.int64).max).min(axis=1) if len(label) else label
            after = np.minimum(label, over)
            if (after == label).all():
                break
            label = after
        return pa.table({"node": pa.array(names), "links": pa.array(links.astype(np.int64)), "tie": pa.array(label), "pairs": pa.array(pairs.astype(np.int64)), "stands_for": pa.array(stands_for.astype(float))})

    return run


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rows: (node, text). (node, hashes), the node's distinct shingles; rows whose text is another node's are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import distinct, mix, shingles

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_by_size(texts, BATCH_CHARS):
                values, at = distinct(*shingles(texts[a:b]))
                n = np.diff(at)
                some = np.flatnonzero(n)
                node = np.zeros(b - a, np.uint64)
                if len(some):
                    node[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][some]) + n[some].astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "hashes"])
                yield out.filter(pa.array(node.view(np.int64) == batch.column(0).slice(a, b - a).to_numpy()))

    return mapped(rows, run, "node long, hashes array<long>")


def _digest(text_column: str):
    return F.xxhash64(text_of(text_column))


def _classified(df: DataFrame, threshold: float, target: float, id_column: str, text_column: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of every row, and of every node its class and ``first``, the least (id, digest) of its rows; null ids come last."""
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), _digest(text_column).alias("digest"))
    signed = written(signatures(rows), "signatures")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.any_value("labels").alias("labels")), "nodes")
    shortest = prefix_depth(threshold, target)
    ties = forest(nodes.where("n > 0").select("node", "labels"), shortest)
    for depth in range(DEPTH, shortest - 1, -1):
        checked = _checked(rows, nodes, ties.where(F.col("depth") >= depth), threshold, depth, block)
        met = checked.agg(F.sum("pairs").alias("pairs"), F.sum("stands_for").alias("all")).first()
        if (met["pairs"] or 0) >= target * (met["all"] or 0):
            break
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("tie").alias("a"), F.col("node").alias("b")), "classes")
    full = nodes.select("node", "rep_id", "first", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = full.groupBy("component").agg(F.min("rep_id").alias("class_id"), F.sum("copies").alias("class_size"))
    held = written(full.join(named, "component").select("node", "component", "first", "rep_id", "class_id", "class_size", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return signed, held


def _checked(rows: DataFrame, nodes: DataFrame, ties: DataFrame, threshold: float, depth: int, block: int) -> DataFrame:
    """Verifies the groups that ties of this prefix length make: of every node, and block of others, its links, a tie to what it is linked to, and the links without copies, as found and as estimated."""
    groups = written(components(ties, "candidates"), "groups")
    # the members' shingles, from their texts
    members = written(groups.join(nodes.select("node", "rep_id", "copies", "n"), "node"), "members")
    n_members = members.count()
    wanted = members.select("node", F.col("rep_id").alias("id"))
    wanted = F.broadcast(wanted) if n_members <= BROADCAST_IDS else wanted
    sets = shingle_sets(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"])).select("node", "text")).dropDuplicates(["node"])
    sized = members.join(members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "component")
    placed = sized.select("node", "component", "blocks", F.col("copies").alias("weight"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("own"))
    # a block meets itself and every other block: side 0 is the lower one
    dealt = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "component", "weight", "hashes", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"))
    return written(dealt.groupBy("component", "low", "high").applyInArrow(_verify(threshold, depth), "node long, links long, tie long, pairs long, stands_for double"), "checked")


def similar_documents(df: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, rep_id, class_size, n_links) of every row.

    rep_id: the least id with the same shingle set; class_id: the least id among
    all documents joined to it by links; n_links: other documents with a Jaccard
    similarity of ``threshold`` or more.
    """
    signed, held = _classified(df, threshold, target, id_column, text_column, block)
    return join_held(signed.select("doc_id", "node"), held.drop("component", "first"), "node", "copies").select("doc_id", "class_id", "rep_id", "class_size", "n_links")


def one_of_each_class(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``df`` of each class of similar documents, that with the least (id, digest of its text); null ids come last. All columns stay, whatever their names."""
    _, held = _classified(df, threshold, RECALL, "doc_id", "text", BLOCK)
    keep, of, digest = (fresh(df, x) for x in ("keep", "of", "digest"))
    first = held.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(keep), F.col("first.digest").alias(of))
    marked = df.withColumn(digest, _digest("text"))
    met = marked.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(of)), "left_semi")
    # only rows of equal id and text are left to choose from
    return met.dropDuplicates(["doc_id", digest]).drop(digest)
