"""Minimax sharding by size (operator 2): DataFrame functions only.

Equal texts form groups that stay together. A group's place in the order is the leading bits of its text's MD5 digest;
all groups with the same leading bits form one atomic unit, so the number of units is bounded by `2 ** UNIT_BITS`
whatever the input's size, and a unit of ordinary texts is a small fraction of a shard. The driver gets one row per unit
(its bytes and rows), binary-searches the smallest capacity at which a greedy walk over the ordered units needs no more
than the wanted shards, and cuts there. Where that leaves shards over (a hot unit sets the capacity), the largest shards
are halved until all are used; none grows.

Slots are numbered in two steps, so that no task has to sort a shard or a hot group: rows are counted per unit and cell
of doc_id, running sums of those counts give each cell its first slot, and rows are numbered inside their cell. Texts are
read once and never shuffled; the few numbers kept of each row are written to the checkpoint folder.

Defined results: a null text counts no bytes and belongs with the empty text; rows that are repeated are all kept and
ordered by doc_id, size and checksum; an empty table gives no rows; with fewer units than shards, some shards are empty; only
the columns named in assign are returned, whatever the others are called.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import ensure_checkpoint_dir

#: Bits of the digest that order the units: at most 65,536 units.
UNIT_BITS = 16
#: doc_ids in a cell of the slot numbering.
CELL_IDS = 4096


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """The first unit of each shard when every shard is filled up to the capacity; all sizes must be within it."""
    cuts, room = [], -1
    for i, s in enumerate(sizes):
        if s > room:
            cuts.append(i)
            room = capacity
        room -= s
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """The first unit of each shard at the smallest capacity for which `shards` contiguous shards suffice."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return spread(sizes, low, shards)


def spread(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """As many shards as there are units, up to `shards`, none above the capacity, which greedy() meets.

    While shards are left, the largest shard of several units is cut where its larger half is least.
    """
    cuts = greedy(sizes, capacity)
    so_far = [0, *accumulate(sizes)]
    heap = [(so_far[a] - so_far[b], a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if b - a > 1]
    heapify(heap)
    while len(cuts) < shards and heap:
        _, a, b = heappop(heap)
        middle = bisect_left(so_far, (so_far[a] + so_far[b]) / 2, a + 1, b - 1)
        cut = min((c for c in (middle - 1, middle) if a < c < b), key=lambda c: max(so_far[c] - so_far[a], so_far[b] - so_far[c]))
        cuts.append(cut)
        for x, y in ((a, cut), (cut, b)):
            if y - x > 1:
                heappush(heap, (so_far[x] - so_far[y], x, y))
    return sorted(cuts)


def assign(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """Returns key, size, text_crc32, shard and slot of every row."""
    ensure_checkpoint_dir(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key_"),
        (F.octet_length(whole) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(whole.cast("binary")), 1, 4), 16, 10).cast("int").alias("unit_"),
    ).withColumn("cell_", F.floor(F.coalesce(F.col("key_"), F.lit(0)) / CELL_IDS))
    rows = rows.checkpoint()  # a few dozen bytes a row; the texts are read this once
    cells = rows.groupBy("unit_", "cell_").agg(F.count("*").alias("n_"), F.sum("size").alias("b_"))
    units = cells.groupBy("unit_").agg(F.sum("n_").alias("n_"), F.sum("b_").alias("b_"))
    sizes = sorted((r.unit_, r.b_) for r in units.select("unit_", "b_").collect())
    cuts = F.array(*[F.lit(sizes[i][0]) for i in minimax_cuts([b for _, b in sizes], shards)] or [F.lit(0)])
    units = units.withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col("unit_"))) - 1)
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_").over(so_far.partitionBy("shard").orderBy("unit_")), F.lit(0))
    placement = F.broadcast(units.select("unit_", "shard", before.alias("before_")))  # one row a unit
    skip = F.coalesce(F.sum("n_").over(so_far.partitionBy("unit_").orderBy("cell_")), F.lit(0))
    first = cells.select("unit_", "cell_", skip.alias("skip_")).join(placement, "unit_")
    within = Window.partitionBy("unit_", "cell_").orderBy("key_", "size", "text_crc32")
    return (
        rows.withColumn("at_", F.row_number().over(within))
        .join(first, ["unit_", "cell_"])
        .select(F.col("key_").alias(key), "size", "text_crc32", "shard", (F.col("before_") + F.col("skip_") + F.col("at_") - 1).cast("long").alias("slot"))
    )


def digest(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Query op2: the law `bytes` over all documents."""
    placed = assign(documents.select("doc_id", "text"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
