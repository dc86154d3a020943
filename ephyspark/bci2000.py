"""BCI2000 recordings as tables: header, parameters, states and signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import register

_OPTIONS = ("mask_states", "compat_trim", "split_bytes")


@dataclass
class Header:
    """First-line values, parameter and state definitions of one recording or of a folder of them."""

    basic: DataFrame
    parameters: DataFrame
    state_definitions: DataFrame

    def tree(self) -> dict:
        """Parameters nested by section, then name; definitions are few, so this is a local dictionary."""
        out: dict = {}
        for r in self.parameters.collect():
            at = out
            for s in r.section:
                at = at.setdefault(s, {})
            at[r.name] = {k: v for k, v in r.asDict().items() if k not in ("file_id", "section", "name")}
        return out

    def describe(self) -> str:
        basic = ", ".join(f"{r['name']}={r['value']}" for r in self.basic.collect())
        return f"<BCI2000 header>\n  {basic}\n  {self.parameters.count()} parameters, {self.state_definitions.count()} states"


@dataclass
class Recording:
    header: Header
    states: DataFrame
    signals: DataFrame

    def calibrated(self) -> DataFrame:
        """Signals less their channel's SourceChOffset, times its SourceChGain; raw where a recording has neither."""
        p = self.header.parameters
        each = lambda name, out: p.where(F.col("name") == name).select("file_id", F.posexplode("values").alias("k", out)).select("file_id", (F.col("k") + 1).alias("channel"), out)
        s = self.signals.join(each("SourceChGain", "gain"), ["file_id", "channel"], "left").join(each("SourceChOffset", "zero"), ["file_id", "channel"], "left")
        value = (F.col("value") - F.coalesce("zero", F.lit(0.0))) * F.coalesce("gain", F.lit(1.0))
        return s.withColumn("value", value).select("file_id", "sample", "channel", "value")


def _load(spark: SparkSession, path: str, table: str, options: dict) -> DataFrame:
    register(spark)
    reader = spark.read.format("bci2000").option("table", table)
    for k, v in options.items():
        if k not in _OPTIONS:
            raise ValueError(f"unknown option {k}")
        reader = reader.option(k, str(v).lower())
    return reader.load(path)


def read_bci2000_header(spark: SparkSession, path: str, **options) -> Header:
    return Header(*(_load(spark, path, t, options) for t in ("basic", "parameters", "state_defs")))


def read_bci2000(spark: SparkSession, path: str, **options) -> Recording:
    """Tables of a recording; options are mask_states, compat_trim and split_bytes."""
    return Recording(read_bci2000_header(spark, path, **options), *(_load(spark, path, t, options) for t in ("states", "signals")))
