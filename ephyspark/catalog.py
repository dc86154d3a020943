"""Import of recordings into a Parquet catalog, and lookups by prefix, event type and channel.

A prefix is a folder. Its tables are replaced file by file, so importing a recording again replaces its earlier rows:
`nev_scans`, `nev_header`, `ext_<TAG>`, `event_<type>`, `event_spike`, `nsx_scans`, `nsx_header`, `channels`, `packets`,
`partition_info` and `signals`, the last one partitioned by which_nsx, original_filename, partition and electrode_id, so
that recordings of one prefix stand side by side.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import channel_name, expand_svec, time_origin_of
from .operators.signal import long_view, packet_offsets, partition_at_pauses, slope_intercept
from .operators.tables import first_match, read_table, upsert_parquet
from .sources import register
from .sources.files import list_files, size, stem
from .sources.nev import read_file as read_nev_file
from .sources.nsx import read_file as read_nsx_file

#: Raw bytes of signals above which a stored signal file gets more partitions.
SPLIT = 128 << 20


@dataclass
class Collection:
    """What a prefix holds: the event file's tables and the signal files by name (ns1 to ns9)."""

    prefix: str
    nev: dict[str, DataFrame]
    nsx: dict[str, DataFrame] = field(default_factory=dict)

    def describe(self) -> str:
        return f"<recording {self.prefix}>\n  events: {', '.join(sorted(k for k in self.nev if k.startswith('event_'))) or 'none'}\n  signals: {', '.join(sorted(self.nsx)) or 'none'}"


def _siblings(path: str) -> tuple[str, list[str]]:
    base = re.sub(r"(?i)\.(nev|ns[1-9])$", "", path)
    found = [p for end in ("nev", *(f"ns{k}" for k in range(1, 10))) for p in list_files(f"{base}.{end}")]
    return base, found


def import_nsp(spark: SparkSession, path: str, prefix: str, exclude_events: str | tuple[str, ...] = ("spike",), exclude_nsx: str | tuple[int, ...] = (), progress: Callable[[str], None] | None = None) -> Collection:
    """Imports an event file and its signal files, given any of them or their common beginning.

    `progress` is called with the name of each file and table when it is done.
    """
    told = progress or (lambda _: None)
    register(spark)
    base, files = _siblings(path)
    skip = set(expand_svec(exclude_nsx)) if isinstance(exclude_nsx, str) else set(exclude_nsx)
    excluded = {e.strip().lower() for e in (exclude_events.split(",") if isinstance(exclude_events, str) else exclude_events)}
    use = [f for f in files if f.lower().endswith(".nev") or int(f[-1]) not in skip]
    if not use:
        raise FileNotFoundError(f"no recording {base}.nev or {base}.ns1 to .ns9")
    for f in use:
        if f.lower().endswith(".nev"):
            import_nev(spark, f, prefix, excluded, told)
        else:
            import_nsx(spark, f, prefix, told)
        told(stem(f))
    return get_nsp(spark, prefix) if any(f.lower().endswith(".nev") for f in use) else Collection(prefix, {}, _signal_tables(spark, prefix))


def import_nev(spark: SparkSession, path: str, prefix: str, exclude_events: set[str] = frozenset({"spike"}), told: Callable[[str], None] = lambda _: None) -> None:
    """Imports the tables of one event file; excluded kinds of events are never decoded."""
    file, name = read_nev_file(path), stem(path)
    read = lambda table: spark.read.format("nev").option("table", table).load(path)
    header = read("header")
    scans = header.select(
        F.lit(re.sub(r"(?i)\.nev$", "", name)).alias("filename"),
        time_origin_of(F.col("time_origin")).alias("acq_time"),
        "original_filename",
        "file_type",
        F.concat_ws(".", F.col("file_spec").cast("array<string>")).alias("file_spec"),
        F.col("application_to_create_file").alias("application"),
        F.lit(file.resolution).cast("bigint").alias("time_resolution_timestamp"),
        F.col("time_resolution_samples").alias("time_resolution_waveforms"),
        "bytes_in_data_packet",
        "comment",
    )

    def put(table: str, df: DataFrame) -> None:
        upsert_parquet(spark, f"{prefix}/{table}", df, "original_filename", [name])
        told(f"{name}: {table}")

    put("nev_scans", scans)
    put("nev_header", header)
    for tag in file.spec.tags:
        put(f"ext_{tag}", read(f"ext:{tag}"))
    for e in file.spec.events:
        if e.event not in exclude_events:
            put(f"event_{e.event}", read(f"event:{e.event}"))


def import_nsx(spark: SparkSession, path: str, prefix: str, told: Callable[[str], None] = lambda _: None) -> None:
    """Imports one signal file: headers, packet index, partitions at pauses and calibrated blocks by channel."""
    file, name = read_nsx_file(path), stem(path)
    which = int(path[-1])
    read = lambda table: spark.read.format("nsx").option("table", table).load(path)
    base = re.sub(r"(?i)\.ns[1-9]$", "", name)

    def put(table: str, df: DataFrame) -> None:
        upsert_parquet(spark, f"{prefix}/{table}", df, "original_filename", [name])
        told(f"{name}: {table}")

    packets = read("packets").withColumn("original_filename", F.lit(name)).withColumn("which_nsx", F.lit(which))
    parts = (
        packets.groupBy("partition", "sample_rate")
        .agg(F.min("t_ref").alias("relative_time"), F.max_by(F.col("t_ref") + F.col("n_data_points") / F.col("sample_rate"), "packet_seq").alias("end_"), F.sum("n_data_points").alias("n_samples"))
        .select(
            F.format_string("%s_ieeg_ns%d_part%d", F.lit(base), F.lit(which), "partition").alias("filename"),
            F.lit(name).alias("original_filename"),
            "partition",
            (F.col("end_") - F.col("relative_time")).alias("duration"),
            "relative_time",
            "sample_rate",
            "n_samples",
            F.concat_ws("-", F.lit(name), F.col("partition").cast("string")).alias("internal_partition_key"),
            F.lit(which).alias("which_nsx"),
        )
    )
    channels = read("channels")
    put("nsx_header", read("header").withColumn("original_filename", F.lit(name)).withColumn("which_nsx", F.lit(which)))
    put("packets", packets)
    put("partition_info", parts)
    table = channels.select(
        F.col("electrode_label").alias("name"),
        F.col("type"),
        F.when(F.col("units").isin("V", "mV"), "uV").otherwise(F.col("units")).alias("units"),
        F.col("sample_rate_signal").alias("sampling_frequency"),
        *(c for k in ("low", "high") for c in (f"{k}_freq_type", f"{k}_freq_order", f"{k}_freq_corner")),
        F.col("electrode_id").alias("original_channel"),
        F.lit(name).alias("original_filename"),
    )
    put("channels", table)
    put("channel_info", channels.withColumn("original_filename", F.lit(name)).withColumn("which_nsp", F.lit(which)).withColumn("filename", channel_name(F.col("electrode_id"), F.col("electrode_label"))))
    put("nsx_scans", read("header").select(F.lit(base).alias("filename"), time_origin_of(F.col("time_origin")).alias("acq_time"), F.lit(name).alias("original_filename"), "file_type", F.concat_ws(".", F.col("file_spec").cast("array<string>")).alias("file_spec"), "period", "channel_count", "label", "time_resolution_timestamp", F.lit(parts.count()).alias("n_partitions")))
    fs_path = f"{prefix}/signals/which_nsx={which}/original_filename={name}"
    blocks = read("samples").drop("which_nsx")
    deal = max(1, -(-size(path) // SPLIT))
    out = blocks.repartition(deal * max(1, min(64, file.header["channel_count"])), "partition", "electrode_id", F.floor(F.col("start_sample") / (1 << 24)))
    out.sortWithinPartitions("partition", "electrode_id", "start_sample").write.mode("overwrite").partitionBy("partition", "electrode_id").parquet(fs_path)


def samples_by_bytes(spark: SparkSession, path: str) -> DataFrame:
    """A second importer of signals, to check the first: file_id, electrode_id, partition, sample and value.

    It takes whole files as binary values (2 GB at most) and walks through their packets one by one; partitions, sample
    numbers and calibration are DataFrame operations. Partitions follow the header's own resolution. Nothing of the data
    source's planning, splitting and numeric code is used but the channel table.
    """
    register(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ns[1-9]").load(path).select("path", "content")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, x in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                wide = x[8] == 3
                end, (period, resolution), count = struct.unpack_from("<I", x, 10)[0], struct.unpack_from("<II", x, 286), struct.unpack_from("<I", x, 310)[0]
                at, head, rows = end, struct.Struct("<BQI" if wide else "<BII"), []
                while at + head.size <= len(x) and x[at] == 1:
                    _, tick, n = head.unpack_from(x, at)
                    at += head.size
                    values = np.frombuffer(x, dtype="<i2", count=n * count, offset=at)
                    rows.append((stem(file), len(rows), tick / resolution, n, 30000 / period, count, values.tolist()))
                    at += 2 * n * count
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int16()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_id", "packet_seq", "t", "n", "rate", "width", "x"])

    p = files.mapInArrow(walk, "file_id string, packet_seq long, t double, n long, rate double, width int, x array<short>")
    p = partition_at_pauses(p, ["file_id"], ["packet_seq"], F.col("t"), F.col("t") + F.col("n") / F.col("rate"), F.lit(2) / F.col("rate"))
    p = packet_offsets(p, "packet_seq", F.col("n"), ["file_id", "partition"], "first_")
    s = p.select("file_id", "partition", "first_", "width", F.posexplode("x").alias("k", "raw"))
    s = s.select("file_id", "partition", (F.col("k") % F.col("width")).alias("position"), (F.col("first_") + F.floor(F.col("k") / F.col("width"))).alias("sample"), "raw")
    channels = slope_intercept(spark.read.format("nsx").option("table", "channels").load(path)).select("file_id", "position", "electrode_id", "slope", "intercept")
    return s.join(channels, ["file_id", "position"]).select("file_id", "electrode_id", "partition", "sample", (F.col("raw") * F.col("slope") + F.col("intercept")).alias("value"))


def _tables(spark: SparkSession, prefix: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(prefix)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def table_names(spark: SparkSession, prefix: str) -> list[str]:
    """Names of all tables that a prefix holds."""
    return _tables(spark, prefix)


def load_all(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """Every table of a prefix, read lazily."""
    return {t: spark.read.parquet(f"{prefix}/{t}") for t in _tables(spark, prefix)}


def load_table(spark: SparkSession, path: str, ram: bool = False):
    """A stored table, lazily, or as a local Arrow table."""
    df = spark.read.parquet(path)
    return df.toArrow() if ram else df


def get_nev(spark: SparkSession, prefix: str) -> dict[str, DataFrame] | None:
    """The event file's tables, or None if none was imported."""
    names = [t for t in _tables(spark, prefix) if t.startswith(("nev_", "ext_", "event_"))]
    return {t: spark.read.parquet(f"{prefix}/{t}") for t in names} or None


def get_nsx(spark: SparkSession, prefix: str, which: int | str) -> DataFrame | None:
    """A signal file's header by number or name ("ns3"), or None."""
    k = int(str(which).lower().removeprefix("ns"))
    if not 1 <= k <= 9:
        raise ValueError(f"there is no ns{k}")
    header = read_table(spark, f"{prefix}/nsx_header")
    header = header.where(F.col("which_nsx") == k) if header is not None else None
    return header if header is not None and not header.isEmpty() else None


def _signal_tables(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    return {f"ns{k}": h for k in range(1, 10) if (h := get_nsx(spark, prefix, k)) is not None}


def get_nsp(spark: SparkSession, prefix: str) -> Collection:
    """The whole recording; an event file must have been imported."""
    nev = get_nev(spark, prefix)
    if nev is None:
        raise FileNotFoundError(f"no event file was imported to {prefix}")
    return Collection(prefix, nev, _signal_tables(spark, prefix))


def get_event(spark: SparkSession, prefix: str, event_type: str) -> DataFrame | None:
    """Events of one type, in file order with packet_seq; None if there are none."""
    return read_table(spark, f"{prefix}/event_{event_type.lower()}")


@dataclass
class Channel:
    """One electrode: its info row and its blocks, which are read when needed."""

    info: DataFrame
    blocks: DataFrame

    def describe(self) -> str:
        r = self.info.first()
        return f"<channel {r.electrode_id} {r.electrode_label}> ns{r.which_nsp}, {r.sample_rate_signal:g} Hz"

    def samples(self) -> DataFrame:
        return long_view(self.blocks)

    def slice(self, partition: int, first: int, last: int) -> DataFrame:
        """Samples first..last (0-based, both included) of a partition; only the blocks that hold them are decoded."""
        own = self.blocks.where((F.col("partition") == partition) & (F.col("start_sample") <= last) & (F.col("start_sample") + F.size("data") > first))
        return long_view(own).where(F.col("sample").between(first, last))

    def dims(self) -> DataFrame:
        """Samples of each partition."""
        return self.blocks.groupBy("partition").agg(F.sum(F.size("data")).cast("bigint").alias("n_samples"))


def get_channel(spark: SparkSession, prefix: str, channel_id: int) -> Channel | None:
    """An electrode in the signal file with the highest number that has it, of the first recording, its first record."""
    info = read_table(spark, f"{prefix}/channel_info")
    if info is None:
        return None
    own = info.where(F.col("electrode_id") == channel_id)
    best = first_match(own.withColumn("down_", -F.col("which_nsp")), ["electrode_id"], ["down_", "original_filename", "position"]).drop("down_")
    row = best.first()
    if row is None:
        return None
    blocks = spark.read.parquet(f"{prefix}/signals").where((F.col("which_nsx") == row.which_nsp) & (F.col("original_filename") == row.original_filename) & (F.col("electrode_id") == channel_id))
    return Channel(best, blocks.drop("original_filename"))


def spike_waveforms(spark: SparkSession, prefix: str) -> DataFrame | None:
    """Spikes with waveforms padded to the longest, first waveform records deciding the calibration."""
    from .operators.signal import pad_to_longest

    spikes = get_event(spark, prefix, "spike")
    return pad_to_longest(spikes, "waveform") if spikes is not None else None


def electrode_labels(spark: SparkSession, prefix: str) -> DataFrame | None:
    """Event-file labels of the electrodes that some signal file has too."""
    labels, info = read_table(spark, f"{prefix}/ext_NEUEVLBL"), read_table(spark, f"{prefix}/channel_info")
    if labels is None or info is None:
        return None
    return first_match(labels, ["electrode_id"], "record_seq").join(info, "electrode_id", "left_semi")
