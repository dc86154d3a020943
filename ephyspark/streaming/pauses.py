"""Continuous recordings as streams: sessions that end at a pause, and upserts of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import upsert_parquet


def sessions(events: DataFrame, channel: str, ts: str, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """Packets of each channel between pauses: start, end and count. State is kept per open session until the watermark."""
    return (
        events.withWatermark(ts, late)
        .groupBy(channel, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n_packets"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
        .drop("w")
    )


def upsert_stream(rows: DataFrame, path: str, index_column: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the stored rows of the keys that it brings."""

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        upsert_parquet(batch.sparkSession, path, batch, index_column, batch)
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
