"""Spark data source "bci2000": self-describing recordings of versions 1.0 and 1.1.

    spark.read.format("bci2000").option("table", "signals").load("/recordings/a.dat")

Tables: `basic`, `parameters`, `state_defs`, `states` (sample, state, value) and `signals` (sample, channel, value). Option
`mask_states` cuts states to their declared length (the format's usual readers don't), `compat_trim` trims values as those
readers do, `split_bytes` is the size of a read task. Samples have a fixed stride, so a file is split at sample borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.text import decode_percent, trim_value
from .files import list_files, open_input, size, stem

FORMATS = {"int16": "<i2", "int32": "<i4", "float32": "<f4"}
SPLIT_BYTES = 16 << 20
#: Characters of a value that number scanning looks at.
NUMBER_CHARS = 1000
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)")

TABLES = {
    "basic": "file_id string, name string, value string",
    "parameters": "file_id string, section array<string>, name string, comment string, data_type string, value double, value_text string, values array<double>, `default` double, lower_bound double, higher_bound double",
    "state_defs": "file_id string, name string, length int, `default` long, byte_location int, bit_location int",
    "states": "file_id string, sample long, state string, value long",
    "signals": "file_id string, sample long, channel int, value double",
}


@dataclass
class StateDef:
    name: str
    length: int
    default: int
    byte: int
    bit: int


@dataclass
class File:
    path: str
    basic: dict[str, str]
    states: list[StateDef]
    parameters: list[str]
    header_bytes: int
    bytes: int
    dtype: np.dtype = field(init=False)

    def __post_init__(self):
        form = self.basic["dataformat"]
        if form not in FORMATS:
            raise ValueError(f"{self.path}: unknown data format {form}")
        channels, state = int(self.basic["sourcech"]), int(self.basic["statevectorlen"])
        self.dtype = np.dtype([("x", FORMATS[form], (channels,)), ("s", "u1", (state,))])

    @property
    def samples(self) -> int:
        return (self.bytes - self.header_bytes) // self.dtype.itemsize


def read_file(path: str) -> File:
    """The text header of a recording."""
    with open_input(path) as f:
        start = f.read(1 << 16)
        line = re.split(rb"\r?\n", start, maxsplit=1)[0].decode("latin-1")
        basic = {k.lower(): v for k, v in re.findall(r"(?:^| )([^= ]+)= ?([^= ]+)", line)}
        if "bci2000v" not in basic:
            basic |= {"bci2000v": "1.0", "dataformat": "int16"}
        if "headerlen" in basic:
            n = int(basic["headerlen"])
            f.seek(0)
            raw = f.read(n)
        else:
            while not (m := re.search(rb"\n[ \t]*\r?\n", start)) and (more := f.read(1 << 16)):
                start += more
            n = m.end() if m else len(start)
            raw = start[:n]
            basic["headerlen"] = str(n)
    lines = re.split(r"\r?\n", raw.decode("latin-1"))
    mark = lambda name: next(i for i, x in enumerate(lines) if re.fullmatch(rf"\[ *{name} *\]", x.strip(), re.I))
    a, b = mark("State Vector Definition"), mark("Parameter Definition")
    states = []
    for x in lines[a + 1 : b]:
        parts = x.split(" ")
        if len(parts) > 4:
            states.append(StateDef(" ".join(parts[:-4]), *map(int, parts[-4:])))
    return File(path, basic, states, lines[b + 1 :], n, size(path))


def numbers(value: str) -> list[float | None]:
    """Numbers and NA of a value, in order; one character after each number is skipped."""
    x, out, i = decode_percent(value, "NA"), [], 0
    while i < len(x) and i <= NUMBER_CHARS:
        if x[i] in "0123456789.-" and (m := _NUMBER.match(x, i)):
            out.append(float(m[0]))
            i = m.end() + 1
        elif x.startswith("NA", i):
            out.append(None)
            i += 1
        else:
            i += 1
    return out


def parse_parameter(line: str, compat_trim: bool = False) -> dict | None:
    """One parameter definition, or None for a line that is none: `Section Type Name= Values // Comment`."""
    line = line.strip(" ")
    m = re.match(r"([^ ]+) ([^ ]+) ([^ ]+)= (.*)$", line, re.S)
    if not m:
        return None
    value, mark, comment = m[4].partition("//")
    value, comment = trim_value(value, compat_trim), trim_value(comment, compat_trim) if mark else ""
    out = {"section": [decode_percent(s, "") for s in m[1].split(":")], "name": m[3], "comment": comment, "data_type": m[2], "value": None, "value_text": None, "values": None, "default": None, "lower_bound": None, "higher_bound": None}
    if m[2] in ("int", "float"):
        n = [*numbers(value), None, None, None, None][:4]
        return out | dict(zip(("value", "default", "lower_bound", "higher_bound"), n, strict=True))
    if m[2] in ("intlist", "floatlist"):
        n = numbers(value)
        if len(n) < 4:
            return out | {"values": []}
        length = int(n[0]) if n[0] is not None and n[0] >= 1 else len(n) - 4
        default, low, high = n[-3:]
        given = n[1:-3]
        return out | {"values": [*given[:length], *[default] * (length - len(given))], "default": default, "lower_bound": low, "higher_bound": high}
    return out | {"value_text": decode_percent(value, "") if m[2] == "string" else value}


def state_values(rows: np.ndarray, d: StateDef, mask: bool) -> np.ndarray:
    """A state of all samples: bytes from its place on, shifted, in the narrowest of 8, 16, 32 or 64 bits that holds it."""
    bits = next(b for b in (8, 16, 32, 64) if d.length <= b) if d.length <= 64 else 64
    value = (rows[:, d.byte] >> np.uint8(d.bit)).astype(np.uint64)
    at, have = d.byte + 1, 8 - d.bit
    while have < d.length and at < rows.shape[1]:
        value += rows[:, at].astype(np.uint64) << np.uint64(have)
        at, have = at + 1, have + 8
    keep = min(bits, d.length) if mask else bits
    return (value & np.uint64(2**keep - 1)).astype(np.int64)


@dataclass
class Split(InputPartition):
    path: str
    first: int = 0
    count: int = 0


class BciDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bci2000"

    def schema(self) -> str:
        table = self.options.get("table", "signals")
        if table not in TABLES:
            raise ValueError(f"unknown table {table}; there are {sorted(TABLES)}")
        return TABLES[table]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BciReader(dict(self.options), schema)


class BciReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.table, self.path, self.schema_ = options.get("table", "signals"), options["path"], schema
        self.mask = options.get("mask_states", "false").lower() == "true"
        self.compat = options.get("compat_trim", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: set | None = None

    def pushFilters(self, filters):
        own = {"signals": ("channel",), "states": ("state",)}.get(self.table)
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if own is not None and values is not None and f.attribute == own:
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        paths = list_files(self.path, ".dat")
        if not paths:
            raise ValueError(f"no recording at {self.path}")
        if self.table not in ("states", "signals"):
            return [Split(p) for p in paths]
        out: list[InputPartition] = []
        for p in paths:
            f = read_file(p)
            step = max(1, self.split_bytes // f.dtype.itemsize)
            out += [Split(p, a, min(step, f.samples - a)) for a in range(0, f.samples, step)]
        return out or [Split("")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, f = to_arrow_schema(self.schema_), read_file(partition.path)
        name = stem(f.path)
        if self.table == "basic":
            rows = [{"name": k, "value": v} for k, v in f.basic.items()]
        elif self.table == "parameters":
            rows = [r for x in f.parameters if (r := parse_parameter(x, self.compat))]
        elif self.table == "state_defs":
            rows = [{"name": d.name, "length": d.length, "default": d.default, "byte_location": d.byte, "bit_location": d.bit} for d in f.states]
        else:
            yield from self._body(f, partition, schema)
            return
        yield pa.RecordBatch.from_pylist([{"file_id": name} | r for r in rows], schema=schema)

    def _body(self, f: File, split: Split, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        with open_input(f.path) as h:
            h.seek(f.header_bytes + split.first * f.dtype.itemsize)
            rows = np.frombuffer(h.read(split.count * f.dtype.itemsize), dtype=f.dtype)
        sample, name = pa.array(np.arange(split.first, split.first + len(rows))), pa.array([stem(f.path)] * len(rows), pa.string())
        if self.table == "signals":
            for c in range(rows["x"].shape[1]):
                if self.wanted is None or c + 1 in self.wanted:
                    yield pa.RecordBatch.from_arrays([name, sample, pa.array(np.full(len(rows), c + 1, dtype=np.int32)), pa.array(rows["x"][:, c].astype(np.float64))], schema=schema)
            return
        for d in f.states:
            if self.wanted is None or d.name in self.wanted:
                yield pa.RecordBatch.from_arrays([name, sample, pa.array([d.name] * len(rows)), pa.array(state_values(rows["s"], d, self.mask))], schema=schema)
