"""Spark data source "nev": neural event files, versions 2.2, 2.3 and 3.0.

    spark.read.format("nev").option("table", "event:comment").load("/recordings")

Tables: `header`, `ext:<TAG>` for one kind of extended header record, `event:<type>` for one kind of packet and `spike` for
calibrated waveforms. All of a folder's files must have one version, which gives the schema; the option `version` names it.
Options: `exclude_events` (comma-separated) skips kinds of events while scanning, `full_waveform` decodes a spike's whole
packet where it is longer than the layout says, `split_bytes` is the size of a read task.

Packets have a fixed length, so a file is split at packet borders and a task decodes its range by record views; packets of
other kinds are never decoded.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..codecs import column, decode, decode_one, kept, record_dtype, spark_type, struct_type, text
from ..codecs import schema as schema_of
from ..specs import EventSpec, FieldSpec, Specification, file_type, get_specification
from .files import list_files, open_input, size, stem

SPLIT_BYTES = 32 << 20
#: Version 3.0 files with a lower time resolution are read at this one.
LEAST_RESOLUTION = 30000
SPIKE = schema_of("original_filename string, packet_seq long, channel_id int, timestamp long, time_in_seconds double, classification int, waveform array<double>")


@dataclass
class File:
    path: str
    spec: Specification
    header: dict
    packets: int

    @property
    def resolution(self) -> int:
        """Ticks a second, repaired for version 3.0."""
        r = self.header["time_resolution_timestamp"]
        return LEAST_RESOLUTION if self.spec.version == "3.0" and r < LEAST_RESOLUTION else r


def read_file(path: str) -> File:
    with open_input(path) as f:
        first = f.read(10)
        kind, version = file_type(first)
        if kind != "nev":
            raise ValueError(f"{path} is no event file")
        spec = get_specification(version, "nev")
        f.seek(0)
        header = decode_one(f.read(sum(x.bytes for x in spec.header)), spec.header)
    length = header["bytes_in_data_packet"]
    n, rest = divmod(size(path) - header["bytes_in_headers"], length) if length > 0 else (0, 0)
    if rest:
        warnings.warn(f"{path}: the last packet is cut and left out", stacklevel=2)
    return File(path, spec, header, max(0, n))


def extended(file: File) -> dict[str, list[dict]]:
    """Extended header records by tag, in file order; an unknown tag is an error."""
    with open_input(file.path) as f:
        f.seek(sum(x.bytes for x in file.spec.header))
        raw = f.read(file.spec.tag_bytes * file.header["number_of_extended_headers"])
    out: dict[str, list[dict]] = {}
    for at in range(0, len(raw), file.spec.tag_bytes):
        record = raw[at : at + file.spec.tag_bytes]
        if len(record) < file.spec.tag_bytes:
            raise ValueError(f"{file.path}: a header record is cut")
        tag = text(record[:8])
        if tag not in file.spec.tags:
            raise ValueError(f"{file.path}: unknown header record {tag!r}")
        out.setdefault(tag, []).append(decode_one(record, file.spec.tags[tag]) | {"record_seq": at // file.spec.tag_bytes})
    return out


def header_schema(spec: Specification) -> T.StructType:
    return T.StructType([T.StructField("original_filename", T.StringType()), *struct_type(spec.header).fields])


def tag_schema(spec: Specification, tag: str) -> T.StructType:
    return T.StructType([T.StructField("original_filename", T.StringType()), T.StructField("record_seq", T.LongType()), *struct_type(spec.tags[tag]).fields])


def event_schema(event: EventSpec) -> T.StructType:
    own = [T.StructField(f.name, spark_type(f)) for f in kept(event.fields)]
    return T.StructType([T.StructField("original_filename", T.StringType()), T.StructField("packet_seq", T.LongType()), *own, T.StructField("event", T.StringType()), T.StructField("time_in_seconds", T.DoubleType())])


@dataclass
class Split(InputPartition):
    path: str
    first: int = 0
    count: int = 0


class NevDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nev"

    def _spec(self) -> Specification:
        if version := self.options.get("version"):
            return get_specification(version, "nev")
        paths = list_files(self.options["path"], ".nev")
        if not paths:
            raise ValueError(f"no event file at {self.options['path']}")
        return read_file(paths[0]).spec

    def schema(self) -> T.StructType:
        spec, (kind, _, name) = self._spec(), self.options.get("table", "header").partition(":")
        if kind == "header":
            return header_schema(spec)
        if kind == "spike" or (kind, name) == ("event", "spike"):
            return SPIKE
        if kind == "ext" and name in spec.tags:
            return tag_schema(spec, name)
        for e in spec.events:
            if kind == "event" and e.event == name.lower():
                return event_schema(e)
        raise ValueError(f"version {spec.version} has no table {self.options.get('table')}")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NevReader(dict(self.options), schema, self._spec().version)


class NevReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType, version: str):
        self.kind, _, self.name = options.get("table", "header").partition(":")
        self.name = self.name.lower() if self.kind == "event" else self.name
        if self.kind == "spike":
            self.kind, self.name = "event", "spike"
        self.path, self.schema_, self.version = options["path"], schema, version
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.full_waveform = options.get("full_waveform", "false").lower() == "true"
        self.excluded = {x.strip().lower() for x in options.get("exclude_events", "").split(",")}

    def partitions(self) -> list[InputPartition]:
        paths = list_files(self.path, ".nev")
        if not paths:
            raise ValueError(f"no event file at {self.path}")
        if self.kind != "event":
            return [Split(p) for p in paths]
        if self.name in self.excluded:
            return [Split("")]
        out: list[InputPartition] = []
        for p in paths:
            file = read_file(p)
            step = max(1, self.split_bytes // max(1, file.header["bytes_in_data_packet"]))
            out += [Split(p, a, min(step, file.packets - a)) for a in range(0, file.packets, step)]
        return out or [Split("")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file = read_file(partition.path)
        if file.spec.version != self.version:
            raise ValueError(f"{file.path} has version {file.spec.version}, not {self.version}; read each version on its own")
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema_)
        if self.kind == "header":
            yield pa.RecordBatch.from_pylist([file.header | {"original_filename": stem(file.path)}], schema=schema)
        elif self.kind == "ext":
            rows = [r | {"original_filename": stem(file.path)} for r in extended(file).get(self.name, [])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        else:
            yield from self._events(file, partition, schema)

    def _events(self, file: File, split: Split, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        event = next((e for e in file.spec.events if e.event == self.name), None)
        if event is None:
            return
        length = file.header["bytes_in_data_packet"]
        with open_input(file.path) as f:
            f.seek(file.header["bytes_in_headers"] + split.first * length)
            data = np.frombuffer(f.read(split.count * length), dtype=np.uint8).reshape(-1, length)
        key = file.spec.key
        if key.offset + 2 > length:
            return
        ids = np.ascontiguousarray(data[:, key.offset : key.offset + 2]).view("<u2")[:, 0]
        own = np.flatnonzero((ids >= event.low) & (ids <= event.high))
        if not len(own):
            return
        raw = np.ascontiguousarray(data[own])
        seq = pa.array((own + split.first).astype(np.int64))
        if self.name == "spike":
            yield from self._spikes(file, event, raw, ids[own].astype(np.int64), seq, schema)
            return
        names, columns = decode(raw.tobytes(), event.fields, length)
        by = dict(zip(names, columns, strict=True))
        if event.comment:
            last = event.fields[-1]
            by[last.name] = pa.array([text(r[last.offset :].tobytes()) for r in raw], pa.string())
        by |= {"original_filename": pa.array([stem(file.path)] * len(own)), "packet_seq": seq, "event": pa.array([self.name] * len(own))}
        by["time_in_seconds"] = pa.array(by["timestamp"].to_numpy() / file.resolution)
        yield pa.RecordBatch.from_arrays([by[f.name].cast(f.type) for f in schema], schema=schema)

    def _spikes(self, file: File, event: EventSpec, raw: np.ndarray, ids: np.ndarray, seq: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Waveforms by their electrode's first NEUEVWAV record; spikes without one, or of an unknown width, are dropped."""
        length = raw.shape[1]
        records = np.frombuffer(raw.tobytes(), dtype=record_dtype(event.fields, length))
        wave: FieldSpec = event.fields[-1]
        end = length if self.full_waveform else min(length, wave.offset + wave.size)
        body = raw[:, wave.offset : end]
        setting: dict[int, dict] = {}
        for r in extended(file).get("NEUEVWAV", []):
            setting.setdefault(r["electrode_id"], r)
        forced = file.header["additional_flags"] == 1
        stamp = column(records, event.fields[0]).to_numpy()
        kind = column(records, event.fields[2]).to_numpy()
        order, waves = [], []
        for electrode in np.unique(ids):
            s = setting.get(int(electrode))
            if s is None:
                warnings.warn(f"{file.path}: no waveform record for electrode {electrode}", stacklevel=2)
                continue
            dtype = "<i2" if forced else {1: "i1", 2: "<i2", 4: "<f4"}.get(s["bytes_per_waveform"] or 1)
            if dtype is None:
                warnings.warn(f"{file.path}: unknown waveform width {s['bytes_per_waveform']}", stacklevel=2)
                continue
            rows = np.flatnonzero(ids == electrode)
            size_ = np.dtype(dtype).itemsize
            values = np.ascontiguousarray(body[rows, : body.shape[1] // size_ * size_]).view(dtype).astype(np.float64)
            order.append(rows)
            waves += list(values * s["digitization_factor"] / 1000)
        if not order:
            return
        rows = np.concatenate(order)
        back = np.argsort(rows, kind="stable")
        rows = rows[back]
        columns = [pa.array([stem(file.path)] * len(rows)), seq.take(pa.array(rows)), pa.array(ids[rows].astype(np.int32)), pa.array(stamp[rows]), pa.array(stamp[rows] / file.resolution), pa.array(kind[rows].astype(np.int32)), pa.array([waves[k] for k in back], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
