"""Decoding of fixed-stride records: layouts become numpy record types, Arrow columns and Spark schemas.

Spark has no unsigned types: 8 and 16 bits are widened, uint32 becomes bigint and uint64 is read as int64.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from .specs import FieldSpec

_NUMPY = {"uint8": "u1", "int8": "i1", "uint16": "<u2", "int16": "<i2", "uint32": "<u4", "int32": "<i4", "uint64": "<i8", "int64": "<i8", "float": "<f4", "double": "<f8", "bit": "u1"}
_WIDE = {"uint8": np.int16, "int8": np.int8, "uint16": np.int32, "int16": np.int16, "uint32": np.int64, "int32": np.int32, "uint64": np.int64, "int64": np.int64, "float": np.float64, "double": np.float64}
_SPARK = {"uint8": T.ShortType(), "int8": T.ByteType(), "uint16": T.IntegerType(), "int16": T.ShortType(), "uint32": T.LongType(), "int32": T.IntegerType(), "uint64": T.LongType(), "int64": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "bit": T.StringType(), "string": T.StringType(), "raw": T.BinaryType()}
_BITS = [" ".join(f"{b >> k & 1:02d}" for k in range(8)) for b in range(256)]

#: Decoders by type name that callers have added: a function of (raw bytes of all values, size) to an Arrow array.
CODECS: dict[str, tuple[Callable[[np.ndarray], pa.Array], T.DataType]] = {}


def register_codec(name: str, decode: Callable[[np.ndarray], pa.Array], spark_type: T.DataType) -> None:
    """Adds or replaces the decoder of a type; it gets an array of raw values of the field's size."""
    CODECS[name] = (decode, spark_type)


def record_dtype(fields: Sequence[FieldSpec], stride: int) -> np.dtype:
    """A record of `stride` bytes; fields that reach beyond it are left out."""
    inside = [f for f in fields if f.offset + f.bytes <= stride]
    formats = []
    for f in inside:
        one = _NUMPY.get(f.type, f"V{f.size}") if f.type not in CODECS else f"V{f.size}"
        formats.append((one, (f.count,)) if f.count > 1 else one)
    return np.dtype({"names": [f.name for f in inside], "formats": formats, "offsets": [f.offset for f in inside], "itemsize": stride})


def text(raw: bytes) -> str:
    """A fixed-width string: up to the first NUL, as UTF-8 or else Latin-1."""
    raw = raw.split(b"\0", 1)[0]
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def spark_type(f: FieldSpec) -> T.DataType:
    one = CODECS[f.type][1] if f.type in CODECS else _SPARK[f.type]
    if f.count == 1:
        return one
    if f.names:
        return T.StructType([T.StructField(n, one) for n in f.names])
    return T.ArrayType(one)


def kept(fields: Sequence[FieldSpec]) -> list[FieldSpec]:
    """Fields that become columns: all but the reserved ones."""
    return [f for f in fields if f.type != "reserved"]


def struct_type(fields: Sequence[FieldSpec]) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f)) for f in kept(fields)])


def _scalars(values: np.ndarray, type: str) -> pa.Array:
    if type in CODECS:
        return CODECS[type][0](values)
    if type == "string":
        return pa.array([text(bytes(v)) for v in values], pa.string())
    if type == "raw":
        return pa.array([bytes(v) for v in values], pa.binary())
    if type == "bit":
        return pa.array([_BITS[v] for v in values.tolist()], pa.string())
    return pa.array(np.ascontiguousarray(values).astype(_WIDE[type]))


def column(records: np.ndarray, f: FieldSpec) -> pa.Array:
    """A field of all records as an Arrow array; null where the records are too short for it."""
    if f.name not in records.dtype.names:
        return pa.nulls(len(records))
    values = records[f.name]
    if f.count == 1:
        return _scalars(values, f.type)
    if f.names:
        return pa.StructArray.from_arrays([_scalars(values[:, k], f.type) for k in range(f.count)], names=list(f.names))
    flat = _scalars(values.reshape(-1), f.type)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(records) * f.count + 1, f.count, dtype=np.int32)), flat)


def decode(buffer: bytes, fields: Sequence[FieldSpec], stride: int) -> tuple[list[str], list[pa.Array]]:
    """Names and columns of all whole records in a buffer."""
    records = np.frombuffer(buffer, dtype=record_dtype(fields, stride), count=len(buffer) // stride)
    use = kept(fields)
    return [f.name for f in use], [column(records, f) for f in use]


def decode_one(buffer: bytes, fields: Sequence[FieldSpec]) -> dict:
    """One record as plain values."""
    stride = max(f.offset + f.bytes for f in fields)
    if len(buffer) < stride:
        raise ValueError(f"the record has {len(buffer)} bytes of {stride}")
    names, columns = decode(buffer[:stride], fields, stride)
    return {n: c[0].as_py() for n, c in zip(names, columns, strict=True)}


_NAMED = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType())}


def schema(text: str) -> T.StructType:
    """A schema from `name type, ...`, without a running session."""
    return T.StructType([T.StructField(n.strip("`"), _NAMED[k]) for n, k in (part.split() for part in text.split(","))])
