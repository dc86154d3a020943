"""Writing recordings: the layouts of `specs` filled from arrays, for test data and for exporting tables as files.

The functions return a file's bytes; a caller that runs in a task writes one file a task, so nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from ..codecs import record_dtype
from ..specs import FieldSpec, get_specification


def records(fields: Sequence[FieldSpec], columns: Mapping[str, object], n: int, size: int | None = None) -> np.ndarray:
    """n records of `size` bytes; fields without a column are zero, texts are padded with NUL."""
    size = size or max(f.offset + f.bytes for f in fields)
    out = np.zeros(n, dtype=record_dtype(fields, size))
    for f in fields:
        if f.name not in columns:
            continue
        value = columns[f.name]
        if f.type in ("string", "raw"):
            many = [value] * n if isinstance(value, (str, bytes)) else value
            raw = [(v if isinstance(v, bytes) else v.encode())[: f.size].ljust(f.size, b"\0") for v in many]
            out[f.name] = np.frombuffer(b"".join(raw), dtype=f"V{f.size}")
        else:
            out[f.name] = value
    return out


def nsx(header: Mapping[str, object], channels: Sequence[Mapping[str, object]], tick: np.ndarray, points: np.ndarray, samples: np.ndarray, version: str = "2.3") -> bytes:
    """A signal file from packet times, samples a packet and all samples (rows by channels)."""
    spec = get_specification(version, "nsx")
    size = sum(f.bytes for f in spec.header) + spec.tag_bytes * len(channels)
    major, minor = version.split(".")
    fixed = {"file_type": "BRSMPGRP" if version == "3.0" else "NEURALCD", "file_spec": [int(major), int(minor)], "bytes_in_headers": size, "channel_count": len(channels)}
    out = [records(spec.header, {**header, **fixed}, 1).tobytes()]
    out += [records(spec.tags["CC"], {"type": "CC", **c}, 1, spec.tag_bytes).tobytes() for c in channels]
    heads = records(spec.packet, {"header": 1, "timestamp": tick, "number_of_data_points": points}, len(tick))
    data = np.ascontiguousarray(samples, dtype="<i2")
    ends = np.cumsum(points)
    for head, end, n in zip(heads, ends.tolist(), np.asarray(points).tolist(), strict=True):
        out += [head.tobytes(), data[end - n : end].tobytes()]
    return b"".join(out)


def nev(header: Mapping[str, object], extended: Sequence[tuple[str, Mapping[str, object]]], packets: Sequence[tuple[str, np.ndarray, Mapping[str, object]]], length: int = 104, version: str = "2.3") -> bytes:
    """An event file; packets are (event, places in the file, columns), and the places of all are 0, 1, 2, ..."""
    spec = get_specification(version, "nev")
    size = sum(f.bytes for f in spec.header) + spec.tag_bytes * len(extended)
    major, minor = version.split(".")
    fixed = {"file_type": "BREVENTS" if version == "3.0" else "NEURALEV", "file_spec": [int(major), int(minor)], "bytes_in_headers": size, "bytes_in_data_packet": length, "number_of_extended_headers": len(extended)}
    out = records(spec.header, {**header, **fixed}, 1).tobytes()
    for tag, values in extended:
        out += records(spec.tags[tag], {"packet_id": tag, **values}, 1, spec.tag_bytes).tobytes()
    body = np.zeros((sum(len(at) for _, at, _ in packets), length), dtype=np.uint8)
    for event, at, columns in packets:
        layout = next(e for e in spec.events if e.event == event)
        rows = records(layout.fields, {"packet_id": layout.low, **columns}, len(at))
        body[at, : rows.dtype.itemsize] = rows.view(np.uint8).reshape(len(at), rows.dtype.itemsize)
    return out + body.tobytes()


def bci(signals: np.ndarray, states: np.ndarray, definitions: Sequence[str], parameters: Sequence[str], form: str = "int16") -> bytes:
    """A BCI2000 recording of version 1.1 from samples (rows by channels) and state bytes (rows by bytes)."""
    kind = {"int16": "<i2", "int32": "<i4", "float32": "<f4"}[form]
    body = "[ State Vector Definition ] \r\n" + "".join(f"{d}\r\n" for d in definitions) + "[ Parameter Definition ] \r\n" + "".join(f"{p}\r\n" for p in parameters) + "\r\n"
    line = lambda n: f"BCI2000V= 1.1 HeaderLen= {n:6d} SourceCh= {signals.shape[1]} StatevectorLen= {states.shape[1]} DataFormat= {form}\r\n"
    head = line(len(line(0)) + len(body)) + body
    rows = np.zeros(len(signals), dtype=[("x", kind, (signals.shape[1],)), ("s", "u1", (states.shape[1],))])
    rows["x"], rows["s"] = signals, states
    return head.encode("latin-1") + rows.tobytes()
