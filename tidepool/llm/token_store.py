"""Token ids in flat binary files (operator 6).

Format, one numbered shard per range of document ids:

* ``NNNNN.ids``: all token ids of the shard's documents, end to end, as unsigned
  little-endian integers, 16 bits wide if the vocabulary allows it, else 32;
* ``NNNNN.off``: document offsets into it, 64-bit, one more than documents;
* ``NNNNN.doc``: document ids, signed 64-bit (null: the least value);
* ``store.json``: the width and, by shard, documents, tokens and the base, that is
  the tokens in all shards before it (a prefix sum of the shards' counts).

Shards are written by the executors into the store's folder, each under a name
of its own attempt and then renamed, so a lost or doubled attempt leaves the
same file. Readers map the files into memory. Stores that are not mounted as a
file system go through ``pyarrow.fs`` and are read in one piece per shard.

Edge cases: a null text is empty and becomes the end id alone; a null id sorts
first; repeated rows are all kept, equal ids in order of their text's digest; an
empty table gives a store without shards.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, mapped, scratch, text_of
from .token_counts import CACHED_PRETOKENS, groups_by_size, special_tokens, split_special

NULL_ID = -(1 << 63)
#: Characters encoded at a time; fewer make more look-ups of the same pretokens.
ENCODE_CHARS = 1_000_000


class Encoder:
    """Ids of whole texts. The library encodes each distinct pretoken once; arrays put the results together."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from .transducer import Pretokenizer

        self.library, self.pretokenizer, self.special = Tokenizer.from_file(path), Pretokenizer(), special_tokens(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        import numpy as np

        self.place: dict[int, int] = {}
        self.ids, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str], end_id: int):
        """All ids, the end id after each text, and the length of each text's."""
        import numpy as np

        from .transducer import Pretokens

        pieces, owner, extra, _ = split_special(texts, self.special)
        p = Pretokens(self.pretokenizer, pieces)
        if len(self.place) > CACHED_PRETOKENS:
            self._clear()
        place, keys = self.place, p.keys.tolist()
        fresh = [i for i, k in enumerate(keys) if k not in place]
        if fresh:
            encoded = [e.ids for e in self.library.encode_batch_fast([p.distinct(i).decode() for i in fresh], add_special_tokens=False)]
            for n, i in enumerate(fresh, len(place)):
                place[keys[i]] = n
            self.ids = np.concatenate([self.ids, np.fromiter((x for e in encoded for x in e), np.uint32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))])
        at = np.fromiter((place[k] for k in keys), np.int64, len(keys))[p.which]
        # one unit per pretoken and one per piece's end: the end id, or the special string that cut the text
        last = np.append(owner[1:] != owner[:-1], True)
        if len(pieces) == len(texts):
            closing = np.full(len(pieces), end_id, np.uint32)
        else:
            import re

            cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
            found = iter([self.special[m] for t in texts for m in cut.findall(t)])
            closing = np.array([end_id if x else next(found) for x in last], np.uint32)
        n_units = len(at) + len(pieces)
        ends = np.bincount(p.text, minlength=len(pieces)).cumsum() + np.arange(len(pieces))
        inner = np.ones(n_units, bool)
        inner[ends] = False
        starts, lengths = np.zeros(n_units, np.int64), np.ones(n_units, np.int64)
        starts[inner], lengths[inner] = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        starts[ends] = len(self.ids) + np.arange(len(pieces))
        stops = np.cumsum(lengths)
        gather = np.arange(stops[-1]) + np.repeat(starts - (stops - lengths), lengths)
        ids = np.concatenate([self.ids, closing])[gather]
        of_text = np.diff(np.concatenate(([0], stops[ends[last]])))
        return ids, of_text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Folder:
    """Files of a store, on a mounted file system or through ``pyarrow.fs``."""

    def __init__(self, uri: str) -> None:
        self.path, self.fs = local_path(uri), None
        if self.path is None:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.fs is None else self.fs.create_dir(self.path, recursive=True)

    def create(self, name: str):
        return open(f"{self.path}/{name}", "wb") if self.fs is None else self.fs.open_output_stream(f"{self.path}/{name}")

    def move(self, name: str, to: str) -> None:
        a, b = f"{self.path}/{name}", f"{self.path}/{to}"
        os.replace(a, b) if self.fs is None else self.fs.move(a, b)

    def read(self, name: str, dtype: str):
        """The whole file as an array; memory-mapped where it can be."""
        import numpy as np

        if self.fs is not None:
            with self.fs.open_input_file(f"{self.path}/{name}") as f:
                return np.frombuffer(f.read(), dtype)
        path = f"{self.path}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> str:
    """Encode every text, append ``end_id`` and write the store; returns its path.

    One range shuffle of (id, text) puts documents in ascending id order; tasks
    stream their rows, so memory holds one batch however large a shard is.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"), F.xxhash64(text_of(text_column)).alias("tie"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = Folder(path)
    folder.make()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        machine, out, attempt = encoder(tokenizer_path), Folder(path), uuid.uuid4().hex
        kinds = {"ids": f"<u{machine.width}", "off": "<i8", "doc": "<i8"}
        files, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = {k: out.create(f"{shard:05d}.{k}.{attempt}") for k in kinds}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            texts = batch.column(1).to_pylist()
            files["doc"].write(np.asarray(batch.column(0).fill_null(NULL_ID)).astype("<i8").tobytes())
            for a, b in groups_by_size(texts, ENCODE_CHARS):
                ids, lengths = machine.encode(texts[a:b], end_id)
                files["ids"].write(ids.astype(kinds["ids"]).tobytes())
                files["off"].write((n_tokens + np.cumsum(lengths)).astype("<i8").tobytes())
                n_tokens += len(ids)
            n_docs += len(texts)
        if files is not None:
            for k, f in files.items():
                f.close()
                out.move(f"{shard:05d}.{k}.{attempt}", f"{shard:05d}.{k}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([n_docs], pa.int64()), "tokens": pa.array([n_tokens], pa.int64()), "width": pa.array([machine.width], pa.int32())})

    placed = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").select("id", "text")
    done = mapped(placed, run, "shard int, docs long, tokens long, width int")
    # one row per shard; base: a prefix sum over the shards
    base, listed = 0, []
    for r in sorted(done.collect()):
        listed.append({"shard": r.shard, "docs": r.docs, "tokens": r.tokens, "base": base, "width": r.width})
        base += r.tokens
    with folder.create("store.json") as f:
        f.write(json.dumps({"shards": listed, "tokens": base, "end_id": end_id}).encode())
    return path


def read_store(spark: SparkSession, path: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of a store, one task per shard: (id, start, n_tokens, ids_crc32), and the ids if asked for."""
    folder = Folder(path)
    listed = json.loads(bytes(folder.read("store.json", "u1")))["shards"]
    schema = f"`{id_column}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        store, step = Folder(path), 2048
        for batch in batches:
            for r in batch.to_pylist():
                ids, off, doc = (store.read(f"{r['shard']:05d}.{k}", d) for k, d in (("ids", f"<u{r['width']}"), ("off", "<i8"), ("doc", "<i8")))
                for a in range(0, r["docs"], step):
                    b = min(a + step, r["docs"])
                    wide = [np.asarray(ids[off[i] : off[i + 1]]).astype("<u4") for i in range(a, b)]
                    names = np.asarray(doc[a:b])
                    columns = [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(r["base"] + np.asarray(off[a:b])), pa.array(np.diff(off[a : b + 1])), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype("i8") for x in wide], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    shards = spark.createDataFrame([(x["shard"], x["docs"], x["tokens"], x["base"], x["width"]) for x in listed], "shard int, docs long, tokens long, base long, width int")
    return mapped(shards.repartition(max(1, len(listed)), "shard"), run, schema)


def token_ids(df: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write a store below the shared folder and read it back."""
    spark = df.sparkSession
    return read_store(spark, write_store(df, scratch(spark, "token-store"), tokenizer_path, end_id))
