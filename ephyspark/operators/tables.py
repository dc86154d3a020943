"""Upserts by key, unions by name, lookups and file sinks."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_table(old: DataFrame | None, new: DataFrame, index_column: str | None = None, obsolete_values: Iterable | DataFrame | None = None) -> DataFrame:
    """Replace-by-key upsert: the new rows and the old rows whose key isn't obsolete, in the new table's columns.

    Obsolete values are a list (one file's names, say) or a table with the key column, which is anti-joined.
    """
    if old is None:
        return new
    if index_column and obsolete_values is not None and index_column in old.columns:
        if isinstance(obsolete_values, DataFrame):
            old = old.join(obsolete_values.select(index_column).distinct(), index_column, "left_anti")
        else:
            values = list(obsolete_values)
            key = F.col(index_column)
            old = old.where(key.isNull() | ~key.isin(*values)) if values else old
    return union_by_name(new, old.select(*[c for c in old.columns if c in new.columns]))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, by column name; a column that a table lacks is null."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def _exists(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, p, fs.exists(p)


def backup_name(path: str, now: float | None = None) -> str:
    """A path with a time stamp before its ending; an earlier stamp is replaced."""
    base = re.sub(r"_\[backup_\d{8}_\d{6}\]", "", path.rstrip("/"))
    head, dot, end = base.rpartition(".")
    stamp = time.strftime("_[backup_%Y%m%d_%H%M%S]", time.localtime(now))
    return f"{head}{stamp}.{end}" if dot and "/" not in end else f"{base}{stamp}"


def backup(spark: SparkSession, path: str) -> str | None:
    """Renames a table's folder to its backup name; None if there is none."""
    fs, p, there = _exists(spark, path)
    if not there:
        return None
    to = backup_name(path)
    fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to))
    return to


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None; an upsert that broke off between its two renames is undone first."""
    fs, p, there = _exists(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(path + _OLD)
    if not there and fs.exists(old):
        there = fs.rename(old, p)
    return spark.read.parquet(path) if there else None


#: What a table is called for the moment in which its successor takes its name.
_OLD = "_replaced"


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, index_column: str | None = None, obsolete_values: Iterable | DataFrame | None = None, tsv: bool = False, keep_backup: bool = False) -> None:
    """`append_table` on a stored table: written beside it under a name of its own and then renamed into its place.

    The old table is renamed away before and deleted after, so a crash leaves one of them whole; read_table finds it.
    """
    if new.isEmpty():
        return
    merged = append_table(read_table(spark, path), new, index_column, obsolete_values)
    staged = f"{path}_{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    fs, p, there = _exists(spark, path)
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (staged, path + _OLD))
    if there and keep_backup:
        backup(spark, path)
    elif there:
        fs.delete(old, True)
        fs.rename(p, old)
    if not fs.rename(fresh, p):
        raise OSError(f"can't put a new table at {path}")
    fs.delete(old, True)
    if tsv:
        write_tsv(read_table(spark, path), path + ".tsv")


def upsert_partition(spark: SparkSession, path: str, new: DataFrame, *keys: str) -> None:
    """Replaces the stored partitions of the keys that the new rows have, and leaves all others alone."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; strings are quoted, nested columns are written as JSON."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.base64(c).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("quoteAll", True).csv(path)


def first_match(df: DataFrame, keys: list[str], order: str | list[str], last: bool = False) -> DataFrame:
    """The first row of each key by the given columns, nulls first, or the last one; one row a key leaves each task."""
    order = [order] if isinstance(order, str) else order
    by = F.struct(*(x for k, c in enumerate(order) for x in (F.col(c).isNotNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))))
    row = (F.max_by if last else F.min_by)(F.struct(*df.columns), by)
    return df.groupBy(*keys).agg(row.alias("row_")).select("row_.*")


def lookup(df: DataFrame, table: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """Inner join with the first row of each key; rows without a match are dropped."""
    return df.join(first_match(table, [right], order), F.col(left) == F.col(right))


def exclude(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose text isn't among the values, without regard to case; nulls stay."""
    own = [v.lower() for v in values]
    c = F.lower(F.col(column))
    return df.where(c.isNull() | ~c.isin(*own)) if own else df


def dispatch(df: DataFrame, ids: str, ranges: list[tuple[int, int, str]], out: str = "event") -> DataFrame:
    """Adds the name of the range that an id lies in; ids in none are dropped. A chain of comparisons, no join."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(ranges):
        label = F.when(F.col(ids).between(low, high), F.lit(name)).otherwise(label)
    return df.withColumn(out, label).where(F.col(out).isNotNull())


def meta_json(df: DataFrame, columns: list[str], out: str = "meta") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*columns)))
