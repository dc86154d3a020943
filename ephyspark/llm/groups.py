"""Documents dealt into groups that talk to shards of a shared table, without any task holding the table.

A group is a few megabytes of documents. It packs what it knows into one row per shard (consecutive binary slices of a
sorted array), a shard's task merges the rows of all groups and answers each in the same order, and the answers come back
to the groups beside their documents. The dealt documents' exchange is the same in every step of a query, so Spark
reuses it and texts are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import input_bytes, partitions_for, prepare

#: Groups that a small input is dealt to at least.
LEAST_GROUPS = 64


def deal(df: DataFrame, text: str, key: str, group_bytes: int) -> tuple[DataFrame, int, int]:
    """The rows with their group `g`, the number of groups, and the input's bytes as stored.

    Rows without a key are dealt by their text, so that many of them are not one group.
    A group has about `group_bytes` as stored; a task works on one group at a time, which bounds its memory.
    The number of groups follows the input's size, so what groups send to a fixed number of shards grows in proportion.
    """
    prepare(df.sparkSession)
    size = input_bytes(df, text)
    few = min(LEAST_GROUPS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(few, math.ceil(size / group_bytes))
    parts = partitions_for(df.sparkSession, size, 12 << 20)
    own = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    return df.withColumn("g", F.pmod(own, F.lit(groups)).cast("int")).repartition(parts, "g"), groups, size


def binary_slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that are consecutive slices of an array, cut at bounds (counted in elements)."""
    off = pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, off, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def flat_binary(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all binary values in a row, and how many each value has."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if off[-1] == off[0]:
        return np.zeros(0, dtype=dtype), np.diff(off)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].view(dtype), np.diff(off) // np.dtype(dtype).itemsize


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of all rows with one key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            piece = b.slice(s, e - s)
            if held and held[0].column(key)[0].as_py() != k[s]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` bytes that hold whole runs of equal keys, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, most
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            held.append(batch.slice(at, 4096))
            size += held[-1].nbytes
            if size < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = 0
            for k in keys:
                v = t.column(k).to_numpy()[cut:]
                cut += int(np.searchsorted(v, v[-1]))
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut).combine_chunks()
            held, size = t.to_batches(), t.nbytes
            enough = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
