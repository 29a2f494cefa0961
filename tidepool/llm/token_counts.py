"""Token counts by finite-state tokenizers (operator 1).

Edge cases: a null text counts as the empty one (0 bytes, 0 tokens); texts of
any length are read whole; repeated rows each get their row; an empty table
gives an empty result; other columns are not read, so names may clash freely.

Counts are remembered by a 64-bit hash of the pretoken (of long ones, by their
SHA-256), without comparing bytes: among a worker's ``CACHED_PRETOKENS`` two
different pretokens share a name with a chance below 1e-8.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, text_of

BATCH_CHARS = 300_000
CACHED_PRETOKENS = 400_000


class Counter:
    """Counts tokens of many texts with the two machines of ``transducer``."""

    def __init__(self, path: str) -> None:
        from .transducer import MergeCounter, Pretokenizer

        self.pretokenizer, self.merges = Pretokenizer(), MergeCounter(path)
        #: Added tokens are found in the raw text before anything else and count one each.
        self.special = special_tokens(path)
        self.cache: dict[int, int] = {}

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        import numpy as np

        from .transducer import Pretokens

        pieces, owner, extra, extra_bytes = split_special(texts, self.special)
        p = Pretokens(self.pretokenizer, pieces)
        if len(self.cache) > CACHED_PRETOKENS:
            self.cache.clear()
        each, cache = np.empty(len(p.keys), np.int64), self.cache
        collecting = gc.isenabled()
        gc.disable()  # only plain tuples and dicts are made here, none in a cycle that could be freed
        try:
            for i, key in enumerate(p.keys.tolist()):
                n = cache.get(key)
                if n is None:
                    n = cache[key] = self.merges.count(p.distinct(i))
                each[i] = n
        finally:
            if collecting:
                gc.enable()
        tokens = np.bincount(owner[p.text], weights=each[p.which], minlength=len(texts)).astype(np.int64) + extra
        n_bytes = np.bincount(owner, weights=p.n_bytes, minlength=len(texts)).astype(np.int64) + extra_bytes
        return n_bytes.tolist(), tokens.tolist()


def special_tokens(path: str) -> dict[str, int]:
    """Added tokens and their ids. Only plain ones, which take no white space along, are supported."""
    added = json.load(open(path, encoding="utf-8")).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip white space or match whole words are not supported")
    return {t["content"]: t["id"] for t in added}


def split_special(texts: list[str], special: dict[str, int]):
    """The pieces between special strings, the text each is of, and the count and bytes of specials by text."""
    import re

    import numpy as np

    extra, extra_bytes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not any(s in t for t in texts for s in special):
        return texts, np.arange(len(texts)), extra, extra_bytes
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    pieces, owner = [], []
    for i, t in enumerate(texts):
        parts = cut.split(t)
        pieces += parts[::2]
        owner += [i] * len(parts[::2])
        extra[i] = len(parts) // 2
        extra_bytes[i] = sum(len(s.encode()) for s in parts[1::2])
    return pieces, np.array(owner, np.int64), extra, extra_bytes


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker and tokenizer: compiled states outlive the batch."""
    return Counter(path)


def groups_by_size(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Spans of consecutive texts with about ``most`` characters; a longer text stands alone, whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_tokens(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text: (id, n_bytes, n_tokens, over_limit).

    A narrow map: no shuffle, memory bounded by ``BATCH_CHARS`` or the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer_path)
        for batch in batches:
            texts, n_bytes, n_tokens = batch.column(1).to_pylist(), [], []
            for a, b in groups_by_size(texts, BATCH_CHARS):
                x, y = machine.count(texts[a:b])
                n_bytes += x
                n_tokens += y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_column].dataType.simpleString()
    return mapped(df.select(id_column, text_of(text_column).alias("text")), run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
