"""Spark data source "nsx": continuous signal files, versions 2.2, 2.3 and 3.0.

    spark.read.format("nsx").option("table", "samples").load("/recordings/*.ns3")

Tables: `header` (one row a file), `channels`, `packets` (the index that a header-only pass gives) and `samples` (blocks of
calibrated microvolts per partition and electrode). Options: `channels` ("1-16,20") reads only some electrodes,
`tolerate_truncation` accepts a cut last packet, `true_time` partitions by the file's own time resolution where versions
2.x would otherwise be partitioned by nanoseconds, `split_bytes` is the size of a read task.

Planning reads file headers, of several files at a time, and of files larger than a read task the packet headers, piece by
piece. Samples are split into byte ranges of whole blocks; a range may span many packets and is read in one piece, so files
with one sample a packet are read as well as files with one packet. The plan holds a few numbers for each range, however many
packets and partitions are in it; the task reads their headers again. Filters on electrode_id and partition are pushed into
the plan where spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..codecs import decode, decode_one, record_dtype, struct_type
from ..codecs import schema as schema_of
from ..specs import Specification, file_type, get_specification
from .files import list_files, open_input, size, stem

#: Samples of a block of one channel, and raw bytes of a read task.
BLOCK, SPLIT_BYTES = 16384, 64 << 20
#: Files whose headers are read at once while planning, and bytes of a file that are looked through at once.
PLANNERS, PIECE = 16, 1 << 20
#: Sampling clock of the format in Hz, and the scale of each unit to microvolts. Fixed values.
CLOCK, MICROVOLTS = 30000, {"V": 1e6, "mV": 1e3}


@dataclass
class Packets:
    """The packet index of a file."""

    tick: np.ndarray
    points: np.ndarray
    offset: np.ndarray
    truncated: bool


@dataclass
class File:
    path: str
    spec: Specification
    header: dict
    channels: list[dict]
    bytes: int

    @property
    def rate(self) -> float:
        return CLOCK / self.header["period"]


def read_file(path: str) -> File:
    """Headers of a signal file."""
    with open_input(path) as f:
        first = f.read(10)
        kind, version = file_type(first)
        if kind != "nsx":
            raise ValueError(f"{path} is no signal file")
        spec = get_specification(version, "nsx")
        f.seek(0)
        n = sum(x.bytes for x in spec.header)
        header = decode_one(f.read(n), spec.header)
        raw = f.read(spec.tag_bytes * header["channel_count"])
    names, columns = decode(raw, spec.tags["CC"], spec.tag_bytes)
    channels = pa.table(columns, names=names).to_pylist()
    if any(c["type"] != "CC" for c in channels):
        raise ValueError(f"{path}: unknown record {sorted({c['type'] for c in channels} - {'CC'})}")
    return File(path, spec, header, channels, size(path))


def scan(file: File, at: int | None = None, piece: int = PIECE) -> Iterator[Packets]:
    """The headers of packets from a byte on, by pieces of the file; ends at the first byte that is no packet marker.

    Packets that follow at a constant stride are read by a record view, which doubles as long as they do. After a packet of
    more than 4096 bytes only the next header is read and the samples are skipped.
    """
    head = sum(x.bytes for x in file.spec.packet)
    one = struct.Struct("<" + "".join({1: "B", 4: "I", 8: "q"}[x.bytes] for x in file.spec.packet))
    width = 2 * file.header["channel_count"]
    at = file.header["bytes_in_headers"] if at is None else at
    n, stride, place = -1, 4097, 1
    with open_input(file.path) as f:
        while place and at + head <= file.bytes:
            f.seek(at)
            data = f.read(min(max(head, piece) if stride <= 4096 else head, file.bytes - at))
            runs, walked, many, place, ended = [], [], 1, 0, False
            while place + head <= len(data):
                marker, tick, now = one.unpack_from(data, place)
                if ended := marker != 1:
                    break
                many, n, stride = 2 * many if now == n else 1, now, head + now * width
                count = min(many, (len(data) - place) // stride)
                if count < 2:
                    walked.append((tick, n, at + place + head))
                    place += stride
                    continue
                rows = np.frombuffer(data, dtype=record_dtype(file.spec.packet, stride), count=count, offset=place)
                same = (rows["header"] == 1) & (rows["number_of_data_points"] == n)
                k = count if same.all() else int(np.argmin(same))
                run = np.stack([rows["timestamp"][:k].astype(np.int64), np.full(k, n), at + place + stride * np.arange(k) + head], axis=1)
                runs += [walked, run]
                walked, place = [], place + k * stride
            found = np.concatenate([np.array(x, dtype=np.int64).reshape(-1, 3) for x in (*runs, walked)])
            if len(found):
                tick, points, offset = np.ascontiguousarray(found.T)
                yield Packets(tick, points, offset, int(offset[-1] + points[-1] * width) > file.bytes)
            if ended:
                return
            at += place


def scan_packets(file: File) -> Packets:
    """The headers of all packets."""
    none = np.zeros(0, dtype=np.int64)
    found = [Packets(none, none, none, False), *scan(file)]
    return Packets(*(np.concatenate([getattr(x, k) for x in found]) for k in ("tick", "points", "offset")), found[-1].truncated)


def seconds(file: File, tick: np.ndarray, true_time: bool) -> np.ndarray:
    """Packet times: by nanoseconds, or by the header's own resolution."""
    return tick / (file.header["time_resolution_timestamp"] if true_time else 1e9)


def partition_numbers(start: np.ndarray, points: np.ndarray, rate: float) -> np.ndarray:
    """1, 2, ... for maximal runs of packets without a gap of more than two samples."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    gap = np.abs(start[1:] - (start[:-1] + points[:-1] / rate)) > 2 / rate
    return np.concatenate([[1], 1 + np.cumsum(gap)]).astype(np.int64)


def calibration(channels: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept to microvolts of each channel."""
    scale = np.array([MICROVOLTS.get(c["units"], 1.0) for c in channels])
    low, high = (np.array([c[k] for c in channels], dtype=np.float64) * scale for k in ("min_analog_value", "max_analog_value"))
    d_low, d_high = (np.array([c[k] for c in channels], dtype=np.float64) for k in ("min_digital_value", "max_digital_value"))
    slope = (high - low) / (d_high - d_low)
    return slope, ((high + low) - slope * (d_high + d_low)) / 2


HEADER = T.StructType([T.StructField("file_id", T.StringType()), *struct_type(get_specification("2.3", "nsx").header).fields, T.StructField("processor_timestamp", T.LongType())])
CHANNELS = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("position", T.IntegerType()), *struct_type(get_specification("2.3", "nsx").tags["CC"]).fields, T.StructField("sample_rate_signal", T.DoubleType()), T.StructField("sample_rate_timestamp", T.LongType())])
PACKETS = schema_of("file_id string, packet_seq long, tick long, t_ref double, t_sec double, n_data_points long, byte_offset long, partition int, partition_true int, sample_rate double")
SAMPLES = schema_of("file_id string, which_nsx int, partition int, electrode_id int, start_sample long, relative_time double, sample_rate double, data array<double>")
TABLES = {"header": HEADER, "channels": CHANNELS, "packets": PACKETS, "samples": SAMPLES}


def which_of(path: str) -> int | None:
    end = path.lower().rpartition(".ns")[2]
    return int(end) if end.isdigit() and len(end) == 1 else None


@dataclass
class Before:
    """What the packets before some packet decide: their partition, its samples so far and first time, and the last one's end."""

    partition: int = 1
    samples: int = 0
    relative_time: float = math.nan
    end: float = math.nan


@dataclass
class Placed:
    """The packets of a piece with their partitions, the samples of those before each packet, and their first times."""

    index: Packets
    points: np.ndarray
    partition: np.ndarray
    start: np.ndarray
    relative_time: np.ndarray
    end: np.ndarray

    def before(self, k: int, first: Before) -> Before:
        """What holds before packet k, `first` before the piece."""
        k -= 1
        return first if k < 0 else Before(int(self.partition[k]), int(self.start[k] + self.points[k]), float(self.relative_time[k]), float(self.end[k]))


def placed(file: File, index: Packets, before: Before, true_time: bool) -> Placed:
    """Places the packets of a piece; a cut last packet has the samples that are there."""
    points = index.points.copy()
    if index.truncated:
        points[-1] = max(0, (file.bytes - index.offset[-1]) // (2 * file.header["channel_count"]))
    t = seconds(file, index.tick, true_time)
    end = t + index.points / file.rate
    gap = np.abs(t - np.append(before.end, end[:-1])) > 2 / file.rate  # false where nothing is before
    first = np.maximum.accumulate(np.where(gap, np.arange(len(t)), -1))  # -1: goes on from the piece before
    total = np.cumsum(points) - points
    since = t[0] if math.isnan(before.relative_time) else before.relative_time
    return Placed(index, points, before.partition + np.cumsum(gap), total - np.where(first < 0, -before.samples, total[first]), np.where(first < 0, since, t[first]), end)


@dataclass
class Split(InputPartition):
    """A read task: a file, and for samples how many from where on, -1 for all; short partitions share a task.

    It begins `skip` samples after the packet whose header is at byte `at`.
    """

    path: str
    samples: int = -1
    at: int | None = None
    skip: int = 0
    before: Before | None = None


class NsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nsx"

    def schema(self) -> T.StructType:
        table = self.options.get("table", "samples")
        if table not in TABLES:
            raise ValueError(f"unknown table {table}; there are {sorted(TABLES)}")
        return TABLES[table]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NsxReader(dict(self.options))


class NsxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "samples")
        self.path = options["path"]
        self.tolerate = options.get("tolerate_truncation", "false").lower() == "true"
        self.true_time = options.get("true_time", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.channels = None
        self.partition_filter: set[int] | None = None
        if wanted := options.get("channels"):
            from ..functions.text import expand_svec

            self.channels = set(expand_svec(wanted))

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if self.table == "samples" and values is not None and f.attribute == ("electrode_id",):
                self.channels = values if self.channels is None else self.channels & values
            elif self.table == "samples" and values is not None and f.attribute == ("partition",):
                self.partition_filter = values if self.partition_filter is None else self.partition_filter & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in list_files(self.path) if which_of(p) is not None or not p.lower().endswith(".nev")]
        if not paths:
            raise ValueError(f"no signal file at {self.path}")
        if self.table != "samples":
            return [Split(p) for p in paths]
        out: list[InputPartition] = []
        with ThreadPoolExecutor(PLANNERS) as pool:
            for splits in pool.map(lambda p: list(self._plan(read_file(p))), paths):
                out += splits
        return out or [Split("")]

    def _plan(self, file: File) -> Iterator[Split]:
        """Read tasks that begin where blocks do; a file that makes only one is not looked into."""
        width = 2 * file.header["channel_count"]
        step = max(1, self.split_bytes // (BLOCK * max(1, width))) * BLOCK
        if file.bytes - file.header["bytes_in_headers"] <= step * width:
            yield Split(file.path)
            return
        head = sum(x.bytes for x in file.spec.packet)
        before, total, least, last = Before(), 0, 0, None
        for index in scan(file):
            self._whole(file, index)
            p = placed(file, index, before, self.true_time)
            ends = total + np.cumsum(p.points)
            begins = ends - p.points
            block = -(-p.start // BLOCK) * BLOCK  # the first block that begins in a packet, or after it
            holds = np.flatnonzero(block < p.start + p.points)
            while (k := int(np.searchsorted(ends, least, side="right"))) < len(ends):
                skip = -(-int(p.start[k] + max(0, least - begins[k])) // BLOCK) * BLOCK - int(p.start[k])
                if skip >= p.points[k]:
                    if (later := int(np.searchsorted(holds, k, side="right"))) == len(holds):
                        break
                    k = int(holds[later])
                    skip = int(block[k] - p.start[k])
                at = int(begins[k]) + skip
                if last is not None:
                    last.samples = at - (least - step)
                    yield last
                last = Split(file.path, 0, int(index.offset[k]) - head, skip, p.before(k, before))
                least = at + step
            before, total = p.before(len(ends), before), int(ends[-1])
        if last is not None:
            last.samples = total - (least - step)
            yield last

    def _whole(self, file: File, index: Packets) -> None:
        if index.truncated and not self.tolerate:
            raise ValueError(f"{file.path}: the last packet is cut; option tolerate_truncation reads what is there")

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file = read_file(partition.path)
        yield from getattr(self, f"_{self.table}")(file, partition)

    def _header(self, file: File, _: Split) -> Iterator[pa.RecordBatch]:
        row = {"file_id": stem(file.path), "processor_timestamp": None} | file.header
        yield _batch([row], HEADER)

    def _channels(self, file: File, _: Split) -> Iterator[pa.RecordBatch]:
        extra = {"file_id": stem(file.path), "sample_rate_signal": file.rate, "sample_rate_timestamp": file.header["time_resolution_timestamp"]}
        yield _batch([c | extra | {"position": k} for k, c in enumerate(file.channels)], CHANNELS)

    def _packets(self, file: File, _: Split) -> Iterator[pa.RecordBatch]:
        p = scan_packets(file)
        t_ref, t_sec = seconds(file, p.tick, False), seconds(file, p.tick, True)
        n = len(p.tick)
        parts = [partition_numbers(t, p.points, file.rate).astype(np.int32) for t in (t_ref, t_sec)]
        columns = [pa.array([stem(file.path)] * n, pa.string()), pa.array(np.arange(n)), *(pa.array(v) for v in (p.tick, t_ref, t_sec, p.points, p.offset, *parts, np.full(n, file.rate)))]
        yield pa.RecordBatch.from_arrays(columns, names=PACKETS.names)

    def _parts(self, file: File, split: Split) -> tuple[np.ndarray, ...]:
        """Partition, samples before, first time, samples and place of the packets, or parts of them, that a task reads."""
        width, before, left, skip, out = 2 * file.header["channel_count"], split.before or Before(), split.samples, split.skip, []
        for index in scan(file, split.at, min(PIECE, max(1 << 16, self.split_bytes))):
            self._whole(file, index)
            p = placed(file, index, before, self.true_time)
            cut = np.zeros(len(p.points), dtype=np.int64)
            cut[0], skip = skip, 0
            points = p.points - cut
            if left >= 0:
                points = np.clip(left - (np.cumsum(points) - points), 0, points)
                left -= int(points.sum())
            use = points > 0
            if self.partition_filter is not None:
                use &= np.isin(p.partition, list(self.partition_filter))
            out.append([v[use] for v in (p.partition, p.start + cut, p.relative_time, points, index.offset + cut * width)])
            if left == 0:
                break
            before = p.before(len(points), before)
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 5

    def _samples(self, file: File, split: Split) -> Iterator[pa.RecordBatch]:
        count = file.header["channel_count"]
        partition, start, relative_time, points, offsets = self._parts(file, split)
        use = [k for k, c in enumerate(file.channels) if self.channels is None or c["electrode_id"] in self.channels]
        if not use or not len(points):
            return
        begin, end = int(offsets[0]), int(offsets[-1] + 2 * points[-1] * count)
        with open_input(file.path) as f:
            f.seek(begin)
            data = f.read(end - begin)
        if len(data) < end - begin:
            raise EOFError(f"{file.path} ends inside a packet")
        raw = packet_samples(np.frombuffer(data, dtype=np.uint8), offsets - begin, points, count)
        slope, intercept = calibration(file.channels)
        # blocks of all partitions: where each begins among the samples read, and what it belongs to
        first = np.flatnonzero(np.diff(partition, prepend=0))
        sizes = np.add.reduceat(points, first)
        blocks = -(-sizes // BLOCK)
        span = np.repeat(np.arange(len(first)), blocks)
        inside = (np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        cuts = pa.array(np.append(np.repeat(np.cumsum(sizes) - sizes, blocks) + inside, len(raw)).astype(np.int32))
        of = lambda v: v[first][span]
        same = lambda v, t: pa.array([v] * len(span), t)
        for k in use:
            x = raw[:, k] * slope[k] + intercept[k]
            columns = [same(stem(file.path), pa.string()), same(which_of(file.path), pa.int32()), pa.array(of(partition).astype(np.int32)), same(file.channels[k]["electrode_id"], pa.int32()), pa.array(of(start) + inside), pa.array(of(relative_time)), same(file.rate, pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(x))]
            yield pa.RecordBatch.from_arrays(columns, names=SAMPLES.names)


def packet_samples(data: np.ndarray, offsets: np.ndarray, points: np.ndarray, count: int) -> np.ndarray:
    """Samples (rows by channels) of packets at the given places; runs of equal packets at an equal stride are one view."""
    out = np.empty((int(points.sum()), count), dtype="<i2")
    stride = np.diff(offsets, append=-1)
    new = np.ones(len(points), dtype=bool)
    new[1:] = (points[1:] != points[:-1]) | (stride[1:] != stride[:-1])
    at = 0
    runs = np.append(np.flatnonzero(new), len(points)).tolist()
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        n, k = int(points[a]), b - a
        view = np.lib.stride_tricks.as_strided(data[int(offsets[a]) :], (k, 2 * n * count), (int(stride[a]) if k > 1 else 0, 1))
        out[at : at + k * n] = np.ascontiguousarray(view).view("<i2").reshape(k * n, count)
        at += k * n
    return out


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=to_arrow_schema(schema))
