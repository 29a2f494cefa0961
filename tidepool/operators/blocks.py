"""Two sides met key by key, their pairs handed on in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 19  # pairs looked at together


def met(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[tuple, pa.StructArray, pa.StructArray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run(key, left rows, right rows)`` for every key both sides have; what it yields is handed on at once, so only a key's rows are held, not its pairs."""
    of = lambda df: F.struct(*[c for c in df.columns if c not in keys])
    a = left.select(*keys, of(left).alias("_l"))
    b = right.select(*keys, of(right).alias("_r"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()
        x, y = (pa.concat_arrays(c.chunks).drop_null() for c in (whole["_l"], whole["_r"]))
        if len(x) and len(y):
            yield from run(tuple(whole[k][0] for k in keys), x, y)

    return a.unionByName(b, allowMissingColumns=True).groupBy(*keys).applyInArrow(group, schema)


def vectors(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)
