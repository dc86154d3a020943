"""File layouts of neural event files (NEV) and continuous signal files (NSx), versions 2.2, 2.3 and 3.0.

A layout is written `name type` or `name type(size)` or `name type*count`, in file order; all numbers are little-endian.
The texts below are fixed values of the file formats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Bytes of one value of each numeric type.
WIDTH = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "uint64": 8, "int64": 8, "float": 4, "double": 8, "bit": 1}
#: Types whose size each layout names.
SIZED = ("string", "raw", "reserved")

VERSIONS = ("2.2", "2.3", "3.0")
MAGIC = {"NEURALEV": "nev", "BREVENTS": "nev", "BRSMPGRP": "nsx", "NEURALCD": "nsx", "NEURALSG": "nsx"}
TIME_ORIGIN = ("Year", "Month", "DayofWeek", "Day", "Hour", "Minute", "Second", "Millisecond")

_NSX_HEADER = "file_type string(8); file_spec uint8*2; bytes_in_headers uint32; label string(16); {comment}; period uint32; time_resolution_timestamp uint32; time_origin uint16*8; channel_count uint32"
_NEV_HEADER = "file_type string(8); file_spec uint8*2; additional_flags uint16; bytes_in_headers uint32; bytes_in_data_packet uint32; time_resolution_timestamp uint32; time_resolution_samples uint32; time_origin uint16*8; application_to_create_file string(32); {comment}; number_of_extended_headers uint32"
_COMMENT = {"2.2": "comment string(252); processor_timestamp uint32", "2.3": "comment string(256)", "3.0": "comment string(256)"}

_CC = "type string(2); electrode_id uint16; electrode_label string(16); physical_connector uint8; connector_pin uint8; min_digital_value int16; max_digital_value int16; min_analog_value int16; max_analog_value int16; units string(16); high_freq_corner uint32; high_freq_order uint32; high_freq_type uint16; low_freq_corner uint32; low_freq_order uint32; low_freq_type uint16"
_FILTER = "high_freq_corner uint32; high_freq_order uint32; high_freq_type uint16; low_freq_corner uint32; low_freq_order uint32; low_freq_type uint16"
_WAVEFORM = "electrode_id uint16; physical_connector uint8; connector_pin uint8; digitization_factor uint16; energy_threshold uint16; high_threshold int16; low_threshold int16; number_of_sorted_units uint8; bytes_per_waveform uint8"
_TAGS = {
    "ARRAYNME": "electrode_array_name string(24)",
    "ECOMMENT": "extra_comment string(24)",
    "CCOMMENT": "continued_comment string(24)",
    "MAPFILE": "map_file string(24)",
    "NEUEVWAV": _WAVEFORM + "; spike_width int16",
    "NEUEVLBL": "electrode_id uint16; label string(16)",
    "NEUEVFLT": "electrode_id uint16; " + _FILTER,
    "DIGLABEL": "label string(16); mode uint8",
    "VIDEOSYN": "video_source_id uint16; video_source string(16); frame_rate float",
    "TRACKOBJ": "trackable_type uint16; trackable_id uint16; point_count uint16; video_source string(16)",
}
_EVENTS_2 = [
    ("65535", "comment", "char_set uint8; flag uint8; data uint32; comment string(12)"),
    ("65534", "video_sync", "video_file_number uint16; video_frame_number uint32; video_elapsed_time uint32; video_source_id uint32"),
    ("65533", "tracking", "parent_id uint16; node_id uint16; node_count uint16; parent_count uint16; tracking_point uint16*7"),
    ("65532", "button_trigger", "trigger_type uint16"),
    ("65531", "configuration", "config_change_type uint16; config_changed string(8)"),
]
_DIGITAL = "packet_insertion_reason bit; reserved reserved(1); digital_input uint16"
_SPIKE = "unit_classification_number uint8; reserved reserved(1); waveform raw({})"
_EVENTS = {
    "2.2": [
        ("0", "digital_inputs", _DIGITAL + "; SMA_input_1 int16; SMA_input_2 int16; SMA_input_3 int16; SMA_input_4 int16"),
        ("1-512", "spike", _SPIKE.format(8)),
        ("5121-5632", "stimulation", "reserved reserved(2); waveform raw(8)"),
        *_EVENTS_2,
    ],
    "2.3": [("0", "digital_inputs", _DIGITAL), ("1-2048", "spike", _SPIKE.format(8)), *_EVENTS_2],
    "3.0": [
        ("0", "digital_inputs", _DIGITAL),
        ("1-32767", "spike", _SPIKE.format(12)),
        ("65535", "comment", "char_set uint8; flag uint8; data uint32; comment string(16)"),
        ("65534", "video_sync", "video_file_number uint16; video_frame_number uint32; video_elapsed_time uint32; video_source_id uint32"),
        ("65533", "tracking", "parent_id uint16; node_id uint16; node_count uint16; parent_count uint16; tracking_point uint16*9"),
        ("65532", "button_trigger", "trigger_type uint16"),
        ("65531", "log", "mode uint16; app_name string(16); log_comment string(28)"),
        ("65530", "configuration", "config_change_type uint16; config_changed string(12)"),
        ("65529", "recording", "event_reason uint16"),
    ],
}
#: Events whose last string goes on to the end of the packet.
COMMENT_PACKETS = {"2.2": {"comment"}, "2.3": {"comment"}, "3.0": {"comment", "log"}}


@dataclass(frozen=True)
class FieldSpec:
    """One field: `count` values of `size` bytes from `offset` on; names make a vector a struct."""

    name: str
    type: str
    size: int
    count: int = 1
    offset: int = 0
    names: tuple[str, ...] = ()

    @property
    def bytes(self) -> int:
        return self.size * self.count


@dataclass(frozen=True)
class EventSpec:
    low: int
    high: int
    event: str
    fields: tuple[FieldSpec, ...]
    comment: bool


@dataclass(frozen=True)
class Specification:
    """All layouts of one kind and version."""

    kind: str
    version: str
    header: tuple[FieldSpec, ...]
    tags: dict[str, tuple[FieldSpec, ...]]
    tag_bytes: int
    packet: tuple[FieldSpec, ...] = ()
    events: tuple[EventSpec, ...] = field(default=())
    key: FieldSpec | None = None


def validate_field(name: str, type: str, size: int | None = None, count: int = 1, offset: int = 0, names: tuple[str, ...] = ()) -> FieldSpec:
    """A field with its width filled in; a size that contradicts the type is an error."""
    if type in WIDTH:
        if size not in (None, WIDTH[type]):
            raise ValueError(f"{name}: {type} has {WIDTH[type]} bytes, not {size}")
        size = WIDTH[type]
    elif type not in SIZED:
        raise ValueError(f"{name}: unknown type {type}")
    elif not size or size < 1:
        raise ValueError(f"{name}: {type} needs a size")
    if count < 1 or names and len(names) != count:
        raise ValueError(f"{name}: wrong count or names")
    return FieldSpec(name, type, size, count, offset, tuple(names))


def layout(text: str, offset: int = 0) -> tuple[FieldSpec, ...]:
    out = []
    for part in text.split(";"):
        m = re.fullmatch(r"\s*(\w+) (\w+)(?:\((\d+)\))?(?:\*(\d+))?\s*", part)
        if not m:
            raise ValueError(f"can't read the field {part!r}")
        count = int(m[4] or 1)
        names = TIME_ORIGIN if m[1] == "time_origin" else ()
        out.append(validate_field(m[1], m[2], int(m[3]) if m[3] else None, count, offset, names))
        offset += out[-1].bytes
    return tuple(out)


@lru_cache
def get_specification(version: str | tuple[int, ...], kind: str) -> Specification:
    """The layouts of a kind ("nev" or "nsx") and version ("2.3" or (2, 3))."""
    v = version if isinstance(version, str) else ".".join(map(str, version))
    if v not in VERSIONS or kind not in ("nev", "nsx"):
        raise ValueError(f"no specification for {kind} {v}")
    stamp = "uint64" if v == "3.0" else "uint32"
    if kind == "nsx":
        packet = layout(f"header uint8; timestamp {stamp}; number_of_data_points uint32")
        return Specification(kind, v, layout(_NSX_HEADER.format(comment=_COMMENT[v])), {"CC": layout(_CC)}, 66, packet)
    tags = {t: layout("packet_id string(8); " + f) for t, f in _TAGS.items() if v != "2.2" or t not in ("VIDEOSYN", "TRACKOBJ")}
    if v == "2.2":
        tags["NEUEVWAV"] = layout(f"packet_id string(8); {_WAVEFORM}; stim_amp_digitization_factor float")
    events = []
    for ids, event, fields in _EVENTS[v]:
        low, _, high = ids.partition("-")
        events.append(EventSpec(int(low), int(high or low), event, layout(f"timestamp {stamp}; packet_id uint16; {fields}"), event in COMMENT_PACKETS[v]))
    return Specification(kind, v, layout(_NEV_HEADER.format(comment=_COMMENT[v])), tags, 32, events=tuple(events), key=validate_field("packet_id", "uint16", offset=8 if v == "3.0" else 4))


def file_type(first: bytes) -> tuple[str, str]:
    """Kind and version from a file's first ten bytes."""
    kind = MAGIC.get(first[:8].decode("latin-1"))
    if kind is None or len(first) < 10:
        raise ValueError(f"unknown file type {first[:8]!r}")
    return kind, f"{first[8]}.{first[9]}"
