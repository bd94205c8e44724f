"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at once, unless the session says otherwise.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python in small batches from now on, if nothing else was set.

    A batch is held whole on both sides, and at Spark's default of 10,000 rows that is tens of megabytes
    of texts for every task.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, and so on; whatever they were called, none clashes."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def number(docs: DataFrame, name: str) -> str:
    """What ``numbered`` calls the column of exactly this name."""
    return f"c{docs.columns.index(name)}"


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads; whatever else the table carries stays behind."""
    text = F.coalesce(F.col(number(docs, text_col)).cast("string"), F.lit(""))
    return numbered(small_batches(docs)).select(F.col(number(docs, id_col)).cast("long").alias("doc_id"), text.alias("text"))


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``limit`` bytes of text (a longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
