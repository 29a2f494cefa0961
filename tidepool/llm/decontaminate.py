"""Test items inside documents: size-partitioned MinHash containment (operator 10).

Items are partitioned by their number of distinct shingles, in classes that
double, each with an index of its own. An item keeps the smallest hashes of its
shingles (a bottom-k MinHash), with k = floor((1 - t) * n) + 1 for the largest n
of its class: a document that holds a share t of the item misses fewer than k of
its shingles, so it holds at least one of the k. That makes the search lossless
at any length of document. Documents have no signature of their own: one of a
whole long document would see next to nothing of a short item, so all shingles
of a document are looked up in the classes' indexes. What the sketches find is
verified by the exact containment of all shingles.

An item of fewer words than a shingle has one shingle, of all its words; it is
sought among the documents' runs of as many words.

Items are meant to be few; their hashes are broadcast up to ``BROADCAST_HASHES``
and otherwise met by a shuffle of the documents' shingles, ``SALTS`` ways for
every hash, so that phrases that most documents have are spread.

Edge cases: null, empty and wordless texts match nothing, on either side; texts
of any length are searched whole; equal items, and rows with equal ids, are
reported each; an empty table on either side gives an empty result, and
``clean_documents`` then keeps every row. Other columns are not read;
``clean_documents`` passes them on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, text_of, written
from .shingles import WIDTH
from .token_counts import BATCH_CHARS, groups_by_size

THRESHOLD = 0.8
#: 8 bytes each: 16 MB of the driver's memory and of each task's.
BROADCAST_HASHES = 2_000_000
SALTS = 16
OUT = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def size_class(n: int) -> int:
    """Sizes from a power of two up to the next are one class."""
    return n.bit_length()


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Smallest hashes that an item keeps: enough for every size in its class."""
    most = (1 << size_class(n)) - 1
    return min(n, math.floor((1 - threshold) * most + 1e-9) + 1)


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, width, hashes, sketch) of every item with a word; width: words of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import distinct, shingles, words

        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            width = np.minimum(np.diff(words(texts)[1]), WIDTH)
            for w in np.unique(width[width > 0]).tolist():
                of = np.flatnonzero(width == w)
                values, at = distinct(*shingles([texts[i] for i in of], w))
                rows = [values[at[i] : at[i + 1]] for i in range(len(of))]
                signed = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.full(len(of), w), pa.int32()), pa.array([v.view(np.int64) for v in rows], signed), pa.array([v[: sketch_size(len(v), threshold)].view(np.int64) for v in rows], signed)], names=["item_id", "width", "hashes", "sketch"])

    return mapped(items.select(F.col(id_column).cast("long").alias("item_id"), text_of(text_column).alias("text")), run, "item_id long, width int, hashes array<long>, sketch array<long>")


class Searcher:
    """Finds items in texts; holds the items' hashes and nothing of the documents."""

    def __init__(self, index: list, threshold: float) -> None:
        import numpy as np

        unsigned = lambda x: np.array(x, np.int64).view(np.uint64)
        self.ids, self.hashes, self.threshold = [r.item_id for r in index], [unsigned(r.hashes) for r in index], threshold
        #: By width of shingles: all hashes of the sketches, and of each size class the hashes and the items they are of.
        self.classes = {}
        for w in sorted({r.width for r in index}):
            sizes, made = sorted({size_class(len(r.hashes)) for r in index if r.width == w}), []
            for c in sizes:
                of = [i for i, r in enumerate(index) if r.width == w and size_class(len(r.hashes)) == c]
                sketch = np.concatenate([unsigned(index[i].sketch) for i in of])
                owner = np.repeat(np.array(of, np.int64), [len(index[i].sketch) for i in of])
                order = np.argsort(sketch, kind="stable")
                made.append((sketch[order], owner[order]))
            self.classes[w] = np.unique(np.concatenate([k for k, _ in made])), made

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shared, shingles of the item) of every hit."""
        from .shingles import shingles

        for a, b in groups_by_size(texts, BATCH_CHARS) if self.classes else ():
            for w, (every, classes) in self.classes.items():
                yield from self._search(a, *shingles(texts[a:b], w), every, classes)

    def _search(self, first: int, values, at, every, classes) -> Iterator[tuple[int, int, int, int]]:
        import numpy as np

        hit = np.flatnonzero(every[np.minimum(np.searchsorted(every, values), len(every) - 1)] == values)
        found = []
        for keys, owners in classes if len(hit) else ():
            left = np.searchsorted(keys, values[hit])
            n = np.searchsorted(keys, values[hit], side="right") - left
            place = np.arange(n.sum()) + np.repeat(left - (np.cumsum(n) - n), n)
            found.append(np.stack([np.repeat(np.searchsorted(at, hit, side="right") - 1, n), owners[place]]))
        previous, mine = -1, None
        for d, i in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist() if found else ():  # candidates only
            if d != previous:
                previous, mine = d, np.unique(values[at[d] : at[d + 1]])
            want = self.hashes[i]
            spot = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
            shared = int((mine[spot] == want).sum())
            if shared >= self.threshold * len(want) - 1e-9:
                yield first + d, i, shared, len(want)


def _searcher(docs: DataFrame, items: DataFrame, threshold: float, broadcast_hashes: int):
    """The items' index, and a broadcast searcher if its size allows one."""
    index = item_shingles(items, threshold)
    size = index.agg(F.sum(F.size("hashes") + F.size("sketch"))).first()[0] or 0
    return index, docs.sparkSession.sparkContext.broadcast(Searcher(index.collect(), threshold)) if size <= broadcast_hashes else None


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for every document that holds at least ``threshold`` of an item."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    index, held = _searcher(docs, items, threshold, broadcast_hashes)
    if held is None:
        return _by_shuffle(rows, index, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = held.value
        for batch in batches:
            found = list(searcher.search(batch.column(1).to_pylist()))
            if found:
                at, item, shared, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([searcher.ids[i] for i in item], pa.int64()), pa.array(shared, pa.int64()), pa.array(n, pa.int64()), pa.array([x / y for x, y in zip(shared, n, strict=True)], pa.float64())], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    return mapped(rows, run, OUT)


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item; all columns stay. A narrow map if the items can be broadcast."""
    index, held = _searcher(docs, items, threshold, broadcast_hashes)
    if held is None:
        leaked = fresh(docs, "leaked")
        bad = _by_shuffle(docs.select(F.xxhash64(text_of(text_column)).alias("doc_id"), text_of(text_column).alias("text")).distinct(), index, threshold).select(F.col("doc_id").alias(leaked)).distinct()
        return docs.join(bad, F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == F.col(leaked), "left_anti")
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = held.value
        for batch in batches:
            bad = {x[0] for x in searcher.search([t or "" for t in batch.column(at).to_pylist()])}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

    return mapped(docs, run, docs.schema)


def _by_shuffle(rows: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """The same by joins: documents' distinct shingles against sketches, then the candidates against all shingles."""
    index = written(index.withColumn("item", F.monotonically_increasing_id()), "items")
    widths = [r.width for r in index.select("width").distinct().collect()]  # WIDTH rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import distinct, shingles

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in groups_by_size(texts, BATCH_CHARS):
                for w in widths:
                    values, at = distinct(*shingles(texts[a:b], w))
                    of = pa.array(np.repeat(np.arange(a, b), np.diff(at)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(values.view(np.int64))], names=["row", "doc_id", "hash"])

    # the text's digest tells rows with equal ids apart; equal rows give equal results
    row = F.xxhash64(F.col("doc_id"), F.col("text")).alias("row")
    times = rows.select(row).groupBy("row").count()
    shingled = written(mapped(rows.select(row, "doc_id", "text").dropDuplicates(["row"]), run, "row long, doc_id long, hash long").withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(SALTS))), "shingles")
    salted = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sketches = salted(index.select("item", F.explode("sketch").alias("hash")))
    pairs = shingled.join(sketches, ["hash", "salt"]).select("row", "item").distinct()
    hashes = salted(index.select("item", "item_id", F.size("hashes").alias("n_shingles"), F.explode("hashes").alias("hash")))
    met = shingled.join(hashes, ["hash", "salt"]).join(pairs, ["row", "item"], "left_semi")
    shared = met.groupBy("row", "doc_id", "item", "item_id", "n_shingles").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9)
    full = shared.join(times, "row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    return full.select("doc_id", "item_id", "n_shared", F.col("n_shingles").cast("long").alias("n_shingles"), (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
