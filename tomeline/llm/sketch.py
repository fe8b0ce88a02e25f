"""Arrays of constant size that all tasks of a map put together.

A task gives its array as BLOCKS rows (block, counts); they are put together in two
rounds, so that no task reads the rows of all others, and BLOCKS rows go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import mix

#: Counters of a frequency sketch, whatever the input; in how many blocks and groups they are added up.
SKETCH, BLOCKS, GROUPS = 2**20, 64, 16
#: Bits of a bitmap of ids (4 MB).
MARKS = 2**25
BLOCK_ROWS = "block long, counts binary"


def counter(h: np.ndarray) -> np.ndarray:
    """The counter of each hash."""
    return (h >> np.uint64(40)).astype(np.int64) % SKETCH


def blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b, part in enumerate(values.reshape(BLOCKS, -1)):
        yield pa.RecordBatch.from_pydict({"block": [b], "counts": [part.tobytes()]})


def _merge(put):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts")):
                c = np.frombuffer(raw.as_py(), np.int64)
                total[b] = put(total[b], c) if b in total else c
        for b, c in total.items():
            yield pa.RecordBatch.from_pydict({"block": [b], "counts": [c.tobytes()]})

    return run


def gathered(rows: DataFrame, put) -> np.ndarray:
    """put (np.add, np.bitwise_or) over the arrays of all tasks, as 64-bit values; of no task, SKETCH zeros."""
    grouped = rows.select("block", "counts", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("group")).repartition(BLOCKS * GROUPS // 8, "block", "group")
    once = grouped.select("block", "counts").mapInArrow(_merge(put), BLOCK_ROWS)
    out: dict[int, np.ndarray] = {}
    for r in once.repartition(BLOCKS // 8, "block").mapInArrow(_merge(put), BLOCK_ROWS).collect():  # BLOCKS rows and no more
        out[r.block] = np.frombuffer(bytes(r.counts), np.int64)
    return np.concatenate([out[b] for b in sorted(out)]) if out else np.zeros(SKETCH, np.int64)


def _place(doc_id: np.ndarray) -> np.ndarray:
    return (mix(doc_id.astype(np.int64).view(np.uint64)) % np.uint64(MARKS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS, np.uint8)
    for batch in batches:
        bits[_place(batch.column("doc_id").to_numpy())] = 1
    yield from blocks(np.packbits(bits))


def bitmap(ids: DataFrame):
    """A broadcast bitmap of hashes of the ids, of constant size: marked() tells of a doc_id whether it
    is perhaps among them.  It only spares texts a shuffle: a join has to decide."""
    bits = gathered(ids.select("doc_id").mapInArrow(_mark, BLOCK_ROWS), np.bitwise_or).view(np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def marked(bits: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    at = _place(doc_id) % (8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def perhaps(docs: DataFrame, ids: DataFrame, shared=None) -> DataFrame:
    """The documents whose id is among ids, and some others.  shared: the bitmap of ids, if it is there."""
    shared = shared or bitmap(ids)

    @F.pandas_udf("boolean")
    def there(doc_id: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, doc_id.to_numpy()))

    return docs.where(there("doc_id"))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ids."""
    return perhaps(docs, ids).join(ids.hint("merge"), "doc_id", "left_semi")
