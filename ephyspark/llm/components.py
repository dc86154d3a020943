"""Connected components of a table of links, by alternating large and small stars.

Each round joins every link twice with a least neighbour; the number of rounds grows with the logarithm of the largest
component. Links are cut from their lineage with checkpoint() after each round, so a lost executor costs one round at
most. The least neighbours are partial minima before they are shuffled, and a node with very many links is one side of
a join with a single row, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import ensure_checkpoint_dir, mix

#: Digests add up modulo this power of two.
_WRAP = 1 << 62


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (id, component): each linked node with the least node it can reach."""
    ensure_checkpoint_dir(links.sparkSession)
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    state = _state(e)
    while state[0]:
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _state(e: DataFrame) -> tuple:
    """Count and order-free digests of the links; a row of three numbers for each partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, y = 0, 0, 0
        for b in batches:
            u, v = (b.column(c).to_numpy().view(np.uint64) for c in ("u", "v"))
            n += b.num_rows
            x, y = (x + int(mix(mix(u) + v).sum())) % _WRAP, (y + int(mix(mix(v) ^ u).sum())) % _WRAP
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([z]) for z in (n, x, y)], names=["n", "x", "y"])

    rows = e.mapInArrow(run, "n long, x long, y long").collect()
    return tuple(sum(r[k] for r in rows) % _WRAP for k in range(3))


def _apart(node: str) -> Column:
    """The node itself, in a form that the planner takes for another column.

    Adaptive execution splits a join's partition only where both sides come from an exchange made for the join; the
    grouping's own partitioning, used again, would leave all links of a hub in one task.
    """
    return F.bitwise_not(F.bitwise_not(node))


def _large_star(e: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the least of the node and its neighbours."""
    least = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least.select(_apart("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Links every node's smaller neighbours, and the node, to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least.select(_apart("u").alias("u"), "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(others).distinct()
