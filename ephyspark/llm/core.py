"""What the operators of this subpackage share: plan sizing, Arrow slicing and vectorised word hashing.

Word hashing works on the bytes of many texts at once. A byte table says which bytes belong to words, so that each
operator can keep its own definition of a word. A word's 64-bit hash goes through its blocks of eight bytes and mixes after
each; a run of words is hashed as a tree of halves that is mixed at each join. Neither is linear in its input, so no two
words collide by construction, only by chance (one pair in 2**64).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

U64 = np.uint64
#: Odd multipliers that keep the two halves of a run apart.
LEFT, RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one with BLAKE2.
LONG_WORD = 256
#: Text bytes that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
#: The mask of the first n bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z become a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def non_space_table() -> np.ndarray:
    """Words are runs of bytes other than space and 0x09 to 0x0D."""
    t = np.ones(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum_table() -> np.ndarray:
    """Words are runs of 0-9, A-Z, a-z and every byte from 0x80."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Entry i is the hash of h[i:i + width]; equal runs have equal hashes wherever they stand."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    run, size, out, have, left = h, 1, None, 0, width
    while True:
        if left & 1:
            out, have = (run[:n], size) if out is None else (_joined(out, run[have : have + n]), have + size)
        left >>= 1
        if not left:
            return mix(out + U64(width))
        run, size = _joined(run[:-size], run[size:]), 2 * size


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * LEFT + b * RIGHT)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def passes(batch: pa.RecordBatch | pa.Table, column: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into consecutive slices of about `most` text bytes, of one row at least."""
    for b in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        if not b.num_rows:
            continue
        ends = np.cumsum(_lengths(b.column(column)))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of many texts, and for each text the index of its first word (n + 1)."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = np.unique(off[(off > 0) & (off < len(data))])
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    h = mix(size.astype(U64) * LEFT + RIGHT)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    block = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = mix(h ^ block[starts] & _FIRST[np.minimum(size, 8)])
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(live):
        h[live] = mix(h[live] ^ block[starts[live] + at] & _FIRST[np.minimum(size[live] - at, 8)])
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of the files that a plan reads, or of its texts where it reads no files. Sizes groups and sketches only."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < 1 << 60:
        return sum(sizes)
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about `each` input bytes, no fewer than spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


#: Bytes of an Arrow batch, where the session leaves it to us. Texts are copied several times on their way to Python.
BATCH_BYTES, _BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_FORMER = ("67108864b", "64MB")


def prepare(spark: SparkSession) -> None:
    """Makes the package known to the tasks, and Arrow batches smaller unless the session has a size of its own."""
    ship(spark)
    if spark.conf.get(_BATCH_SETTING, None) in _FORMER:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def share(df: DataFrame, value):
    """A broadcast of something whose size is bounded, for tasks that find this package."""
    prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a local master (one machine, as in tests) gets a temporary folder and any other is an error, as its
    executors would not find each other's files. Also makes the package known to the tasks.
    """
    prepare(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def renamed(df: DataFrame, new: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that nothing else has, and those names by the old; columns named like new ones are left out."""
    taken = {n.lower() for n in new}
    names = {c: f"c{i}_" for i, c in enumerate(df.columns) if c.lower() not in taken}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
