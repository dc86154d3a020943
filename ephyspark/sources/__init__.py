"""Spark data sources for the binary recording formats."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Makes the formats "nsx", "nev" and "bci2000" known, with filters pushed into their plans."""
    from ..session import ship
    from .bci import BciDataSource
    from .nev import NevDataSource
    from .nsx import NsxDataSource

    ship(spark)
    for source in (NsxDataSource, NevDataSource, BciDataSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
