"""Byte-level writers of small recordings for the tests."""

from __future__ import annotations

import struct

import numpy as np

from ephyspark.specs import FieldSpec, get_specification

_CODE = {"uint8": "B", "int8": "b", "uint16": "H", "int16": "h", "uint32": "I", "int32": "i", "uint64": "Q", "int64": "q", "float": "f", "double": "d", "bit": "B"}


def pack(fields: tuple[FieldSpec, ...], values: dict, size: int | None = None) -> bytes:
    """A record; missing values are zero, strings are padded with NUL."""
    out = b""
    for f in fields:
        v = values.get(f.name, 0)
        if f.type in _CODE:
            v = list(v) if f.count > 1 and v else [v or 0] * f.count if not isinstance(v, (list, tuple)) else v
            out += struct.pack(f"<{f.count}{_CODE[f.type]}", *v)
        else:
            raw = v if isinstance(v, bytes) else str(v or "").encode()
            out += raw[: f.size].ljust(f.size, b"\0")
    return out.ljust(size, b"\0") if size else out


ORIGIN = (2023, 7, 2, 18, 9, 5, 7, 42)


def nsx(path, version="2.3", channels=None, packets=(), period=15, resolution=30000, tail=b"", cut=0):
    """packets: (tick, array samples x channels)."""
    spec = get_specification(version, "nsx")
    channels = channels or [{"electrode_id": k + 1, "electrode_label": f"ch{k + 1}"} for k in range(3)]
    size = sum(f.bytes for f in spec.header) + 66 * len(channels)
    head = {"file_type": "BRSMPGRP" if version == "3.0" else "NEURALCD", "file_spec": tuple(map(int, version.split("."))), "bytes_in_headers": size, "label": "2 kS/s", "comment": "test", "period": period, "time_resolution_timestamp": resolution, "time_origin": ORIGIN, "channel_count": len(channels)}
    out = pack(spec.header, head)
    for c in channels:
        out += pack(spec.tags["CC"], {"type": "CC", "min_digital_value": -32764, "max_digital_value": 32764, "min_analog_value": -8191, "max_analog_value": 8191, "units": "uV"} | c)
    for tick, data in packets:
        data = np.asarray(data, dtype="<i2")
        out += pack(spec.packet, {"header": 1, "timestamp": tick, "number_of_data_points": len(data)}) + data.tobytes()
    out += tail
    with open(path, "wb") as f:
        f.write(out[: len(out) - cut])


def nev(path, version="2.3", extended=(), packets=(), length=104, resolution=30000, flags=0):
    """extended: (tag, values); packets: (event, packet_id, values), or raw bytes."""
    spec = get_specification(version, "nev")
    size = sum(f.bytes for f in spec.header) + 32 * len(extended)
    head = {"file_type": "NEURALEV" if version != "3.0" else "BREVENTS", "file_spec": tuple(map(int, version.split("."))), "additional_flags": flags, "bytes_in_headers": size, "bytes_in_data_packet": length, "time_resolution_timestamp": resolution, "time_resolution_samples": 30000, "time_origin": ORIGIN, "application_to_create_file": "tests", "comment": "c", "number_of_extended_headers": len(extended)}
    out = pack(spec.header, head)
    for tag, values in extended:
        out += pack(spec.tags[tag], {"packet_id": tag} | values, 32)
    for p in packets:
        if isinstance(p, bytes):
            out += p.ljust(length, b"\0")
            continue
        event, pid, values = p
        fields = next(e.fields for e in spec.events if e.event == event)
        raw = pack(fields, {"packet_id": pid} | values)
        if "tail" in values:
            last = fields[-1]
            raw = raw[: last.offset] + values["tail"]
        out += raw.ljust(length, b"\0")
    with open(path, "wb") as f:
        f.write(out)


def bci(path, fmt="int16", version="1.1", channels=2, samples=50, states=(), parameters=(), seed=0):
    """states: (name, length, value, byte, bit); returns signals and state bytes."""
    r = np.random.default_rng(seed)
    dtype = {"int16": "<i2", "int32": "<i4", "float32": "<f4"}[fmt]
    x = (r.standard_normal((samples, channels)) * 1000).astype(dtype)
    width = max([1, *(b + (bit + n + 7) // 8 for _, n, _, b, bit in states)])
    s = r.integers(0, 256, (samples, width), dtype=np.uint8)
    body = "[ State Vector Definition ] \r\n" + "".join(f"{n} {l} {v} {b} {k}\r\n" for n, l, v, b, k in states)
    body += "[ Parameter Definition ] \r\n" + "".join(p + "\r\n" for p in parameters) + "\r\n"
    line = lambda n: (f"BCI2000V= {version} HeaderLen= {n:6d} SourceCh= {channels} StatevectorLen= {width} DataFormat= {fmt}\r\n" if version != "1.0" else f"SourceCh= {channels} StatevectorLen= {width}\r\n")
    head = line(len(line(0)) + len(body)) + body
    with open(path, "wb") as f:
        f.write(head.encode())
        for a, b in zip(x, s, strict=True):
            f.write(a.tobytes() + b.tobytes())
    return x, s
