"""Numeric arrays of any rank as Parquet: allocated with a fill value, written slice by slice, read lazily by index.

An array is a folder with `meta` (its dimensions and fill value) and `cells` (indices from 1, value and the number of the
write). Slices may be written in any order and overlap; the last write of a cell counts. Nothing is preallocated: cells
that were never written have the fill value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import _exists, read_table

Index = Sequence[int] | Sequence[bool] | None


def _columns(rank: int) -> list[str]:
    return [f"i{k + 1}" for k in range(rank)]


class ArrayStore:
    """A stored array; handles are cheap, data is read when a result is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.path}/meta")[2]

    def allocate(self, dims: Sequence[int], fill: float | None = 0.0) -> ArrayStore:
        """A new array of positive dimensions; replaces what was there."""
        if not dims or any(int(d) < 1 for d in dims):
            raise ValueError(f"dimensions must be positive, not {list(dims)}")
        fs, p, there = _exists(self.spark, f"{self.path}/cells")
        if there:
            fs.delete(p, True)
        meta = self.spark.range(1).select(F.array(*[F.lit(int(d)).cast("long") for d in dims]).alias("dims"), F.lit(fill).cast("double").alias("fill"))
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        return self

    def save(self, values: np.ndarray) -> ArrayStore:
        """A whole array at once."""
        values = np.asarray(values)
        return self.allocate(values.shape).write(values, [1] * values.ndim)

    def _meta(self):
        if not self.exists():
            raise FileNotFoundError(f"no array at {self.path}")
        return self.spark.read.parquet(f"{self.path}/meta").first()

    def dims(self) -> tuple[int, ...]:
        return tuple(self._meta().dims)

    def __len__(self) -> int:
        return int(np.prod(self.dims()))

    def write(self, values: np.ndarray, start: Sequence[int]) -> ArrayStore:
        """Writes a slice whose first cell has the 1-based index `start`."""
        values, dims = np.asarray(values, dtype=np.float64), self.dims()
        if values.ndim != len(dims) or len(start) != len(dims):
            raise ValueError(f"the array has rank {len(dims)}, the slice {values.ndim} and its start {len(start)}")
        if any(s < 1 for s in start) or any(s + n - 1 > d for s, n, d in zip(start, values.shape, dims, strict=True)):
            raise IndexError(f"a slice of {values.shape} at {list(start)} is outside {dims}")
        import pyarrow as pa

        at = np.indices(values.shape).reshape(values.ndim, -1)
        cells = {c: pa.array(at[k] + start[k]) for k, c in enumerate(_columns(values.ndim))} | {"value": pa.array(values.reshape(-1), from_pandas=True)}
        return self.write_rows(self.spark.createDataFrame(pa.table(cells)))

    def write_rows(self, cells: DataFrame) -> ArrayStore:
        """Writes cells given as rows of i1, i2, ... and value; the distributed form of `write`."""
        old = read_table(self.spark, f"{self.path}/cells")
        number = (old.agg(F.max("write")).first()[0] or 0) + 1 if old is not None else 1
        columns = [F.col(c).cast("long").alias(c) for c in _columns(len(self.dims()))]
        cells.select(*columns, F.col("value").cast("double").alias("value"), F.lit(number).cast("long").alias("write")).write.mode("append").parquet(f"{self.path}/cells")
        return self

    def cells(self) -> DataFrame:
        """Written cells, each with its last value."""
        own = _columns(len(self.dims()))
        stored = read_table(self.spark, f"{self.path}/cells")
        if stored is None:
            return self.spark.range(0).select(*[F.col("id").alias(c) for c in own], F.lit(None).cast("double").alias("value"))
        last = Window.partitionBy(*own).orderBy(F.desc("write"))
        return stored.withColumn("r", F.row_number().over(last)).where("r = 1").select(*own, "value")

    def subset(self, *index: Index) -> DataFrame:
        """Cells at the given indices: one list per dimension, None for all, or a mask.

        Order and repeats are kept as positions p1, p2, ...; an index outside the array gives null.
        """
        meta = self._meta()
        dims = tuple(meta.dims)
        if len(index) != len(dims):
            raise ValueError(f"the array has rank {len(dims)}, not {len(index)}")
        want = None
        for k, (i, d) in enumerate(zip(index, dims, strict=True)):
            p, c = f"p{k + 1}", f"i{k + 1}"
            if i is None:
                one = self.spark.range(1, d + 1).select(F.col("id").alias(p), F.col("id").alias(c))
            else:
                numbers = [n + 1 for n, x in enumerate(i) if x] if len(i) and all(isinstance(x, (bool, np.bool_)) for x in i) else [int(x) for x in i]
                one = self.spark.range(1).select(F.posexplode(F.array(*[F.lit(n).cast("long") for n in numbers]).cast("array<bigint>")).alias("p", c)).select((F.col("p") + 1).cast("long").alias(p), c)
            want = one if want is None else want.crossJoin(one)  # the requested shape
        own = _columns(len(dims))
        inside = F.lit(True)
        for c, d in zip(own, dims, strict=True):
            inside = inside & F.col(c).between(1, d)
        got = want.join(self.cells().withColumn("there", F.lit(True)), own, "left")
        return got.select(*[f"p{k + 1}" for k in range(len(dims))], *own, F.when(F.col("there"), F.col("value")).when(inside, F.lit(meta.fill)).alias("value"))

    def collect(self, *index: Index) -> np.ndarray:
        """A subset as a local array; NaN where there is no value."""
        index = index or (None,) * len(self.dims())
        rows = self.subset(*index).toPandas()
        shape = [d if i is None else sum(map(bool, i)) if len(i) and all(isinstance(x, (bool, np.bool_)) for x in i) else len(i) for i, d in zip(index, self.dims(), strict=True)]
        out = np.full(shape, np.nan)
        if len(rows):
            out[tuple(rows[f"p{k + 1}"].to_numpy() - 1 for k in range(len(shape)))] = rows.value.to_numpy(dtype=np.float64, na_value=np.nan)
        return out
