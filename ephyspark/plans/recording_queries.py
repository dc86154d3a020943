"""Queries that store tables as recordings, decode them with the data sources, and are compared with the tables by SQL.

`events` becomes recordings of RECORDING consecutive event_ids: a task writes the files of one recording to the shared
folder, whatever the table's size, and only their number comes back. Every query runs over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bci2000, catalog
from ..functions.text import expand_svec
from ..operators import signal as S
from ..operators.arrays import ArrayStore
from ..operators.tables import first_match, read_table, upsert_parquet, upsert_partition
from ..session import shared_folder
from ..sources import encode, register
from ..sources.files import make_folder, write_file

#: Events of a recording, milliseconds of 2024-01-01, ticks a second, samples a second of the signal files.
RECORDING, BEGIN, RESOLUTION, RATE = 2048, 1_704_067_200_000, 1000, 2000
_KINDS = {"click": "digital_inputs", "view": "comment", "purchase": "button_trigger", "error": "spike", "signup": "video_sync"}
_ORIGIN = [2024, 1, 1, 1, 9, 5, 7, 42]
_CHANNELS = [
    {"electrode_id": 3, "electrode_label": "LA1", "min_digital_value": -32764, "max_digital_value": 32764, "min_analog_value": -8191, "max_analog_value": 8191, "units": "uV"},
    {"electrode_id": 7, "electrode_label": "mic", "min_digital_value": -1000, "max_digital_value": 3000, "min_analog_value": -5, "max_analog_value": 5, "units": "mV"},
]
_PARAMETERS = ["Tab:Source int SampleRate= 256 100 0 5000 // samples%20a second", "Tab floatlist SourceChGain= 2 0.5 0.25 1 0 10 // gain", "Tab intlist SourceChOffset= 2 10 20 0 0 10 //", "Notes string Title= a%20b%25c // ", "Tab:Filter float Cutoff= 0.5 1 NA 70.5 // Hz"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) - {BEGIN}")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.floor(F.col("event_id") / RECORDING).cast("long").alias("rec"), "event_id", "user_id", "event_type", ms.alias("tick"), "props")


def _written(spark: SparkSession, sf_dir: str, ending: str, content: Callable[[dict[str, np.ndarray]], bytes]) -> str:
    """A folder with one file a recording, written by the tasks that hold its events."""
    register(spark)
    folder = make_folder(shared_folder(spark))

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("event_id")
        rec = t.column("rec")[0].as_py()
        write_file(f"{folder}/rec{rec:06d}.{ending}", content({c: t.column(c).to_numpy() for c in t.column_names}))
        return pa.table([pa.array([rec])], names=["rec"])

    _events(spark, sf_dir).groupBy("rec").applyInArrow(write, "rec long").count()
    return folder


def _nev(e: dict[str, np.ndarray]) -> bytes:
    packets = []
    for kind, event in _KINDS.items():
        at = np.flatnonzero(e["event_type"] == kind)
        user, stamp = e["user_id"][at], {"timestamp": e["tick"][at]}
        own = {
            "digital_inputs": {"packet_insertion_reason": user % 256, "digital_input": user % 65536},
            "comment": {"data": user, "flag": 1, "comment": [str(x)[:12] for x in e["props"][at]]},
            "button_trigger": {"trigger_type": user % 7},
            "spike": {"packet_id": 1 + user % 3, "unit_classification_number": user % 5, "waveform": [np.array([u % 100, -(u % 50), 7, u % 9], dtype="<i2").tobytes() for u in user.tolist()]},
            "video_sync": {"video_file_number": user % 65536, "video_frame_number": e["event_id"][at], "video_elapsed_time": e["tick"][at], "video_source_id": 5},
        }[event]
        packets.append((event, at, stamp | own))
    waves = [("NEUEVWAV", {"electrode_id": k, "digitization_factor": 250 * k, "bytes_per_waveform": 2, "high_threshold": -k}) for k in (1, 2)]
    labels = [("NEUEVLBL", {"electrode_id": k, "label": f"elec{k}"}) for k in (1, 2, 3)]
    header = {"time_resolution_timestamp": RESOLUTION, "time_resolution_samples": 30000, "time_origin": _ORIGIN, "application_to_create_file": "export", "comment": "events"}
    return encode.nev(header, waves + labels, packets)


def _nsx(e: dict[str, np.ndarray]) -> bytes:
    points = 1 + e["event_id"] % 3
    which = np.repeat(np.arange(len(points)), points)
    s = np.arange(len(which)) - np.repeat(np.cumsum(points) - points, points)
    samples = np.stack([(e["user_id"][which] * 7 + s * 13 + 100 * c) % 2000 - 1000 for c in range(2)], axis=1)
    header = {"label": "events", "comment": "events", "period": 30000 // RATE, "time_resolution_timestamp": RESOLUTION, "time_origin": _ORIGIN}
    return encode.nsx(header, _CHANNELS, e["tick"], points, samples)


def _bci(e: dict[str, np.ndarray]) -> bytes:
    signals = np.stack([e["user_id"] % 30000, e["event_id"] % 1000 - 500], axis=1)
    user = e["user_id"].astype(np.uint64)
    word = (user % 256) | ((e["event_id"].astype(np.uint64) % 4096) << np.uint64(11))
    states = np.stack([(word >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8) for k in range(3)], axis=1)
    return encode.bci(signals, states, ["Stim 8 0 0 0", "Code 12 7 1 3"], _PARAMETERS)


def _file(column: str) -> F.Column:
    return F.regexp_extract(column, r"rec(\d+)", 1).cast("long").alias("rec")


def _nev_table(spark, sf_dir, table, **options) -> DataFrame:
    return spark.read.format("nev").options(table=table, split_bytes=64 << 10, **options).load(_written(spark, sf_dir, "nev", _nev))


def nev_digital(spark, sf_dir):
    return _nev_table(spark, sf_dir, "event:digital_inputs").select(_file("original_filename"), "packet_seq", "timestamp", "time_in_seconds", "packet_insertion_reason", "digital_input", "event")


def nev_comments(spark, sf_dir):
    return _nev_table(spark, sf_dir, "event:comment").select(_file("original_filename"), "packet_seq", "timestamp", F.col("flag").cast("int").alias("flag"), "data", "comment")


def nev_buttons(spark, sf_dir):
    """Two kinds of events; kinds that are excluded while scanning give no row."""
    folder = _written(spark, sf_dir, "nev", _nev)
    read = lambda kind: spark.read.format("nev").options(table=f"event:{kind}", exclude_events="comment, Spike").load(folder)
    own = lambda kind, value: read(kind).select(_file("original_filename"), "packet_seq", "event", F.col(value).cast("long").alias("value"))
    return own("button_trigger", "trigger_type").union(own("video_sync", "video_frame_number")).union(own("comment", "data"))


def nev_spikes(spark, sf_dir):
    """Waveforms in microvolts by their electrode's record; electrode 3 has none and its spikes are dropped."""
    s = _nev_table(spark, sf_dir, "spike")
    return S.pad_to_longest(s, "waveform").select(_file("original_filename"), "packet_seq", "channel_id", "timestamp", "time_in_seconds", "classification", F.posexplode("waveform").alias("pos", "microvolts"))


def nev_records(spark, sf_dir):
    """Extended header records in file order, with the header's own fields."""
    folder = _written(spark, sf_dir, "nev", _nev)
    read = lambda table: spark.read.format("nev").option("table", table).load(folder)
    labels, waves = read("ext:NEUEVLBL").select("original_filename", "record_seq", "electrode_id", "label"), read("ext:NEUEVWAV")
    first = first_match(waves, ["original_filename", "electrode_id"], "record_seq").select("original_filename", "electrode_id", "digitization_factor", "high_threshold")
    head = read("header").select("original_filename", F.concat_ws(".", F.col("file_spec").cast("array<string>")).alias("version"), F.col("time_origin.Hour").cast("int").alias("hour"), "bytes_in_headers")
    return labels.join(first, ["original_filename", "electrode_id"], "left").join(head, "original_filename").select(_file("original_filename"), "record_seq", "electrode_id", "label", *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("digitization_factor", "high_threshold")), "version", "hour", "bytes_in_headers")


def _nsx_table(spark, sf_dir, table, **options) -> DataFrame:
    return spark.read.format("nsx").options(table=table, split_bytes=32 << 10, **options).load(_written(spark, sf_dir, "ns3", _nsx))


def nsx_packets(spark, sf_dir):
    p = _nsx_table(spark, sf_dir, "packets")
    return p.select(_file("file_id"), "packet_seq", "tick", "t_ref", "t_sec", "n_data_points", "byte_offset", "partition", "partition_true", "sample_rate")


def nsx_channels(spark, sf_dir):
    folder = _written(spark, sf_dir, "ns3", _nsx)
    c = S.slope_intercept(spark.read.format("nsx").option("table", "channels").load(folder))
    h = spark.read.format("nsx").option("table", "header").load(folder).select("file_id", "label", "period", F.col("channel_count").cast("int").alias("channel_count"))
    return c.join(h, "file_id").select(_file("file_id"), "position", "electrode_id", "electrode_label", "units", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), "sample_rate_signal", "label", "period", "channel_count")


def nsx_samples(spark, sf_dir):
    """Calibrated samples, one a row, of partitions by the header's own resolution."""
    s = S.long_view(_nsx_table(spark, sf_dir, "samples", true_time="true"))
    return s.select(_file("file_id"), "partition", "electrode_id", "sample", F.round("time", 6).alias("time"), F.round("value", 9).alias("microvolts"))


def nsx_one_channel(spark, sf_dir):
    """One electrode, chosen while reading; by blocks of nanosecond partitions and their ranges of samples."""
    s = _nsx_table(spark, sf_dir, "samples", channels="7").where("electrode_id = 7")
    return s.groupBy(_file("file_id"), "partition").agg(F.sum(F.size("data")).cast("long").alias("n_samples"), F.round(F.sum(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


def importers_agree(spark, sf_dir):
    """Both importers of signals over the same files: keys that only one has, and the largest difference."""
    folder = _written(spark, sf_dir, "ns3", _nsx)
    read = spark.read.format("nsx").option("table", "samples")
    a = S.long_view(read.option("true_time", "true").load(folder)).select("file_id", "electrode_id", "partition", "sample", "value")
    return S.compare(a, catalog.samples_by_bytes(spark, folder), ["file_id", "electrode_id", "partition", "sample"])


def _bci_recording(spark, sf_dir, **options) -> bci2000.Recording:
    return bci2000.read_bci2000(spark, _written(spark, sf_dir, "dat", _bci), split_bytes=16 << 10, **options)


def bci_signals(spark, sf_dir):
    s = _bci_recording(spark, sf_dir).calibrated()
    return s.select(_file("file_id"), "sample", "channel", "value")


def bci_states(spark, sf_dir):
    """States cut to their declared lengths."""
    return _bci_recording(spark, sf_dir, mask_states=True).states.select(_file("file_id"), "sample", "state", "value")


def bci_parameters(spark, sf_dir):
    p = _bci_recording(spark, sf_dir).header.parameters
    return p.select(_file("file_id"), F.array_join("section", "/").alias("section"), "name", "data_type", "value", "value_text", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("list"), F.col("default").alias("standard"), "lower_bound", "higher_bound", "comment")


def bci_definitions(spark, sf_dir):
    h = _bci_recording(spark, sf_dir).header
    basic = h.basic.where("name = 'sourcech'").select("file_id", F.col("value").cast("int").alias("channels"))
    return h.state_definitions.join(basic, "file_id").select(_file("file_id"), "name", "length", F.col("default").alias("standard"), "byte_location", "bit_location", "channels")


def array_slices(spark, sf_dir):
    """An array of nations by two, written in overlapping slices; a subset with repeats and an index that isn't there."""
    store = ArrayStore(spark, shared_folder(spark)).allocate([30, 2], fill=-1.0)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1).alias("i1"), F.col("n_regionkey").alias("r"))
    store.write_rows(n.select("i1", F.lit(1).alias("i2"), F.col("r").alias("value"))).write_rows(n.where("r = 2").select("i1", F.lit(1).alias("i2"), F.lit(50).alias("value")))
    store.write(np.arange(6.0).reshape(3, 2), [28, 1])
    return store.subset(expand_svec("1-30") + [3, 99], [2, 1])


def _both(base: str) -> Callable[[pa.Table], pa.Table]:
    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("event_id")
        e = {c: t.column(c).to_numpy() for c in t.column_names}
        write_file(f"{base}.nev", _nev(e))
        write_file(f"{base}.ns3", _nsx(e))
        return pa.table([t.column("rec").slice(0, 1)], names=["rec"])

    return write


def catalog_events(spark, sf_dir):
    """Two recordings in one catalog, the first one imported again: events, channels and signals of both."""
    register(spark)
    folder, prefix = make_folder(shared_folder(spark)), shared_folder(spark)
    for name, table, key in (("a", "supplier", "s_suppkey"), ("b", "region", "r_regionkey")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.lit(0).cast("long").alias("rec"), F.col(key).cast("long").alias("event_id"), F.col(key).cast("long").alias("user_id"), F.lit("click").alias("event_type"), (F.col(key) * 2000).cast("long").alias("tick"), F.lit("").alias("props"))
        rows.groupBy("rec").applyInArrow(_both(f"{folder}/{name}"), "rec long").count()  # one recording of one small table
    for name in ("a", "b", "a"):
        catalog.import_nsp(spark, f"{folder}/{name}.nev", prefix)
    found = catalog.get_nsp(spark, prefix)
    events = catalog.get_event(spark, prefix, "digital_inputs").select(F.col("original_filename").alias("file"), F.lit("event").alias("kind"), F.col("packet_seq").alias("key"), F.col("digital_input").cast("double").alias("value"))
    parts = spark.read.parquet(f"{prefix}/partition_info").groupBy(F.col("original_filename").alias("file"), F.lit("samples").alias("kind"), F.lit(1).cast("long").alias("key")).agg(F.sum("n_samples").cast("double").alias("value"))
    signals = spark.read.parquet(f"{prefix}/signals").select(F.col("file_id").alias("file"), F.lit("signal").alias("kind"), F.col("electrode_id").cast("long").alias("key"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("x")).groupBy("file", "kind", "key").agg(F.round(F.sum("x"), 6).alias("value"))
    headers = found.nsx["ns3"].select(F.col("original_filename").alias("file"), F.lit("header").alias("kind"), F.col("which_nsx").cast("long").alias("key"), F.col("period").cast("double").alias("value"))
    piece = catalog.get_channel(spark, prefix, 7).slice(partition=1, first=1, last=4)
    piece = piece.select(F.col("file_id").alias("file"), F.lit("slice").alias("kind"), F.col("sample").alias("key"), F.round("value", 6).alias("value"))
    return events.union(parts).union(signals).union(headers).union(piece)


def stored_upserts(spark, sf_dir):
    """A stored table after an upsert by key and the replacement of one partition."""
    path = shared_folder(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    upsert_parquet(spark, f"{path}/orders", o)
    upsert_parquet(spark, f"{path}/orders", o.where("o_orderstatus = 'F'").withColumn("version", F.lit(2)), "o_orderkey", o.where("o_orderstatus = 'F'"))
    upsert_partition(spark, f"{path}/dealt", o, "o_orderstatus")
    upsert_partition(spark, f"{path}/dealt", o.where("o_orderstatus = 'P'").withColumn("version", F.lit(3)), "o_orderstatus")
    return read_table(spark, f"{path}/orders").withColumn("store", F.lit("keys")).unionByName(read_table(spark, f"{path}/dealt").withColumn("store", F.lit("partitions")))


def tsv_and_backup(spark, sf_dir):
    """The backup of a stored table, and its successor read from its tab-separated copy."""
    path = f"{shared_folder(spark)}/suppliers"
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.concat(F.lit("a\"\t"), F.col("s_nationkey").cast("string")).alias("note"))
    upsert_parquet(spark, path, s)
    upsert_parquet(spark, path, s.withColumn("s_name", F.upper("s_name")), "s_suppkey", s, tsv=True, keep_backup=True)
    kept = spark.read.parquet(f"{path}_*backup*").withColumn("store", F.lit("backup"))
    tsv = spark.read.option("sep", "\t").option("header", True).schema(s.schema).csv(f"{path}.tsv").withColumn("store", F.lit("tsv"))
    return kept.unionByName(tsv)


_ALL = [nev_digital, nev_comments, nev_buttons, nev_spikes, nev_records, nsx_packets, nsx_channels, nsx_samples, nsx_one_channel, importers_agree, bci_signals, bci_states, bci_parameters, bci_definitions, array_slices, catalog_events, stored_upserts, tsv_and_backup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_E = f"(SELECT *, event_id // {RECORDING} AS rec, row_number() OVER (PARTITION BY event_id // {RECORDING} ORDER BY event_id) - 1 AS packet_seq, epoch_us(ts) // 1000 - {BEGIN} AS tick, 1 + event_id % 3 AS n FROM events) AS e"
_FLAGS = "'0' || (u & 1) || " + " || ".join(f"' 0' || ((u >> {k}) & 1)" for k in range(1, 8))
_RECS = f"(SELECT DISTINCT event_id // {RECORDING} AS rec FROM events) AS r"


def _gaps(unit: str) -> str:
    """Packets with their times in seconds and partitions, by nanoseconds or by the header's resolution."""
    return f"""(
      SELECT *, CAST(1 + sum(brk) OVER (PARTITION BY rec ORDER BY packet_seq) AS INTEGER) AS part FROM (
        SELECT *, CASE WHEN abs(t - lag(t + n / {RATE}::DOUBLE) OVER (PARTITION BY rec ORDER BY packet_seq)) > 2 / {RATE}::DOUBLE THEN 1 ELSE 0 END AS brk
        FROM (SELECT *, tick / {unit}::DOUBLE AS t FROM {_E}) AS x
      ) AS y
    ) AS g"""


_VALUES = "(VALUES (3, 0, 8191.0 / 32764, 0.0), (7, 1, 2.5, -2500.0)) AS c(electrode_id, c, slope, intercept)"


def _samples(unit: str) -> str:
    return f"""(
      SELECT rec, part, electrode_id, before + s AS sample, first_t + (before + s) / {RATE}::DOUBLE AS "time", ((user_id * 7 + s * 13 + 100 * c) % 2000 - 1000) * slope::DOUBLE + intercept::DOUBLE AS microvolts
      FROM (
        SELECT *, CAST(sum(n) OVER w - n AS BIGINT) AS before, first_value(t) OVER w AS first_t, unnest(range(n)) AS s
        FROM {_gaps(unit)} WINDOW w AS (PARTITION BY rec, part ORDER BY packet_seq)
      ) AS p, {_VALUES}
    ) AS s"""


_PARAMETER_ROWS = "('Tab/Source','SampleRate','int',256.0,NULL,NULL,100.0,0.0,5000.0,'samples%20a second'), ('Tab','SourceChGain','floatlist',NULL,NULL,'0.5 0.25',1.0,0.0,10.0,'gain'), ('Tab','SourceChOffset','intlist',NULL,NULL,'10.0 20.0',0.0,0.0,10.0,''), ('Notes','Title','string',NULL,'a b%c',NULL,NULL,NULL,NULL,''), ('Tab/Filter','Cutoff','float',0.5,NULL,NULL,1.0,NULL,70.5,'Hz')"
_FILES = "(SELECT 'a' AS f, s_suppkey::BIGINT AS k FROM supplier UNION ALL SELECT 'b', r_regionkey::BIGINT FROM region) AS f"

_SQL = {
    "nev_digital": f"SELECT rec, packet_seq, tick AS timestamp, tick / {RESOLUTION}::DOUBLE AS time_in_seconds, {_FLAGS.replace('u ', 'user_id ')} AS packet_insertion_reason, CAST(user_id % 65536 AS INTEGER) AS digital_input, 'digital_inputs' AS event FROM {_E} WHERE event_type = 'click'",
    "nev_comments": f"SELECT rec, packet_seq, tick AS timestamp, 1 AS flag, user_id AS data, substr(props, 1, 12) AS comment FROM {_E} WHERE event_type = 'view'",
    "nev_buttons": f"SELECT rec, packet_seq, CASE event_type WHEN 'purchase' THEN 'button_trigger' ELSE 'video_sync' END AS event, CASE event_type WHEN 'purchase' THEN user_id % 7 ELSE event_id END AS value FROM {_E} WHERE event_type IN ('purchase', 'signup')",
    "nev_spikes": f"SELECT rec, packet_seq, CAST(1 + user_id % 3 AS INTEGER) AS channel_id, tick AS timestamp, tick / {RESOLUTION}::DOUBLE AS time_in_seconds, CAST(user_id % 5 AS INTEGER) AS classification, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN user_id % 100 WHEN 1 THEN -(user_id % 50) WHEN 2 THEN 7 ELSE user_id % 9 END * (250 * (1 + user_id % 3))::DOUBLE / 1000 AS microvolts FROM {_E}, (VALUES (0), (1), (2), (3)) AS p(pos) WHERE event_type = 'error' AND user_id % 3 < 2",
    "nev_records": f"SELECT rec, CAST(1 + k AS BIGINT) AS record_seq, k AS electrode_id, 'elec' || k AS label, CASE WHEN k < 3 THEN 250 * k ELSE 0 END AS digitization_factor, CASE WHEN k < 3 THEN -k ELSE 0 END AS high_threshold, '2.3' AS version, 9 AS hour, CAST(336 + 5 * 32 AS BIGINT) AS bytes_in_headers FROM {_RECS}, (VALUES (1), (2), (3)) AS v(k)",
    "nsx_packets": f'SELECT g.rec, g.packet_seq, g.tick, g.t AS t_ref, h.t AS t_sec, g.n AS n_data_points, CAST(314 + 2 * 66 + 9 + sum(9 + 4 * g.n) OVER (PARTITION BY g.rec ORDER BY g.packet_seq) - (9 + 4 * g.n) AS BIGINT) AS byte_offset, g.part AS "partition", h.part AS partition_true, {RATE}::DOUBLE AS sample_rate FROM {_gaps("1e9")} JOIN {_gaps(str(RESOLUTION)).removesuffix("g")}h USING (event_id)',
    "nsx_channels": f"SELECT rec, CAST(c AS INTEGER) AS position, CAST(electrode_id AS INTEGER) AS electrode_id, CASE c WHEN 0 THEN 'LA1' ELSE 'mic' END AS electrode_label, 'uV' AS units, round(slope::DOUBLE, 9) AS slope, round(intercept::DOUBLE, 9) AS intercept, {RATE}::DOUBLE AS sample_rate_signal, 'events' AS label, {30000 // RATE}::BIGINT AS period, 2 AS channel_count FROM {_RECS}, {_VALUES}",
    "nsx_samples": f'SELECT rec, part AS "partition", electrode_id, sample, round("time", 6) AS "time", round(microvolts, 9) AS microvolts FROM {_samples(str(RESOLUTION))}',
    "nsx_one_channel": f'SELECT rec, part AS "partition", count(*) AS n_samples, round(sum(microvolts), 6) AS total FROM {_samples("1e9")} WHERE electrode_id = 7 GROUP BY rec, part',
    "importers_agree": "SELECT 0::BIGINT AS n_missing, 0::DOUBLE AS max_diff, true AS equal",
    "bci_signals": f"SELECT rec, packet_seq AS sample, c AS channel, CASE c WHEN 1 THEN (user_id % 30000 - 10) * 0.5::DOUBLE ELSE (event_id % 1000 - 500 - 20) * 0.25::DOUBLE END AS value FROM {_E}, (VALUES (1), (2)) AS c(c)",
    "bci_states": f"SELECT rec, packet_seq AS sample, s AS state, CASE s WHEN 'Stim' THEN user_id % 256 ELSE event_id % 4096 END AS value FROM {_E}, (VALUES ('Stim'), ('Code')) AS s(s)",
    "bci_parameters": f"SELECT rec, p.* FROM {_RECS}, (VALUES {_PARAMETER_ROWS}) AS p(section, name, data_type, value, value_text, list, standard, lower_bound, higher_bound, comment)",
    "bci_definitions": f"SELECT rec, d.*, 2 AS channels FROM {_RECS}, (VALUES ('Stim', 8, 0::BIGINT, 0, 0), ('Code', 12, 7::BIGINT, 1, 3)) AS d(name, length, standard, byte_location, bit_location)",
    "array_slices": "SELECT p1, p2, i1, i2, CASE WHEN i1 > 30 THEN NULL WHEN i1 >= 28 THEN (i1 - 28) * 2 + i2 - 1 WHEN i2 = 1 AND n_regionkey = 2 THEN 50 WHEN i2 = 1 AND n_regionkey IS NOT NULL THEN n_regionkey ELSE -1 END::DOUBLE AS value FROM (SELECT CASE k WHEN 31 THEN 3 WHEN 32 THEN 99 ELSE k END AS i1, k AS p1 FROM range(1, 33) AS t(k)) AS a CROSS JOIN (VALUES (1::BIGINT, 2::BIGINT), (2, 1)) AS b(p2, i2) LEFT JOIN nation ON n_nationkey + 1 = i1",
    "catalog_events": f"""
      SELECT f || '.nev' AS file, 'event' AS kind, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS key, (k % 65536)::DOUBLE AS value FROM {_FILES}
      UNION ALL SELECT f || '.ns3', 'samples', 1, sum(1 + k % 3)::DOUBLE FROM {_FILES} GROUP BY f
      UNION ALL SELECT f || '.ns3', 'signal', electrode_id, round(sum(((k * 7 + s * 13 + 100 * c) % 2000 - 1000) * slope::DOUBLE + intercept::DOUBLE), 6) FROM (SELECT *, unnest(range(1 + k % 3)) AS s FROM {_FILES}) AS x, {_VALUES} GROUP BY f, electrode_id
      UNION ALL SELECT DISTINCT f || '.ns3', 'header', 3, {30000 // RATE}::DOUBLE FROM {_FILES}
      UNION ALL SELECT 'a.ns3', 'slice', key, ((k * 7 + s * 13 + 100) % 2000 - 1000) * 2.5::DOUBLE - 2500 FROM (VALUES (1::BIGINT, 1, 0), (2, 1, 1), (3, 2, 0), (4, 2, 1)) AS v(key, k, s)""",
    "tsv_and_backup": "SELECT s_suppkey, s_name, 'a\"' || chr(9) || s_nationkey AS note, 'backup' AS store FROM supplier UNION ALL SELECT s_suppkey, upper(s_name), 'a\"' || chr(9) || s_nationkey, 'tsv' FROM supplier",
    "stored_upserts": "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS version, 'keys' AS store FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 3 ELSE 1 END, 'partitions' FROM orders",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
