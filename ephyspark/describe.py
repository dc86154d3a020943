"""Short texts that show what an object of this package holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bci2000 import Header, Recording
from .catalog import Channel, Collection
from .operators.arrays import ArrayStore
from .specs import EventSpec, FieldSpec, Specification

#: Rows of a table that a text shows.
ROWS = 5


def _lines(title: str, items: Iterable[str]) -> str:
    return "\n".join([f"<{title}>", *(f"  {x}" for x in items)])


def _field(f: FieldSpec) -> str:
    return f"{f.name}: {f.type}{f' x {f.count}' if f.count > 1 else ''}, {f.bytes} bytes at {f.offset}"


def _event(e: EventSpec) -> str:
    ids = f"{e.low}" if e.low == e.high else f"{e.low} to {e.high}"
    return f"{e.event} ({ids}): {', '.join(f.name for f in e.fields)}"


def _specification(s: Specification) -> str:
    parts = [f"header: {', '.join(f.name for f in s.header)}"]
    parts += [f"record {t}: {', '.join(f.name for f in fields)}" for t, fields in s.tags.items()]
    parts += [f"packet: {', '.join(f.name for f in s.packet)}"] if s.packet else [f"event {_event(e)}" for e in s.events]
    return _lines(f"{s.kind} {s.version}", parts)


def _recording(r: Recording) -> str:
    states = ", ".join(sorted(x.state for x in r.states.select("state").distinct().collect()))
    n = r.signals.agg(F.count_distinct("channel").alias("c"), F.max("sample").alias("s")).first()
    return f"{r.header.describe()}\n  {n.c} channels, {0 if n.s is None else n.s + 1} samples; states: {states or 'none'}"


def _array(a: ArrayStore) -> str:
    return f"<array {' x '.join(map(str, a.dims()))}> {a.path}" if a.exists() else f"<no array> {a.path}"


def describe(x: object) -> str:
    """A text for a layout, a header, an event or channel table, a channel, a collection, an array or a recording."""
    kinds = {Specification: _specification, FieldSpec: lambda f: f"<field {_field(f)}>", EventSpec: lambda e: _lines(f"event {_event(e)}", map(_field, e.fields)), Recording: _recording, ArrayStore: _array}
    for kind, show in kinds.items():
        if isinstance(x, kind):
            return show(x)
    if isinstance(x, (Header, Channel, Collection)):
        return x.describe()
    if isinstance(x, DataFrame):
        return describe_table(x)
    raise TypeError(f"nothing to say about {type(x).__name__}")


def describe_table(df: DataFrame, title: str | None = None) -> str:
    """A stored table by what its columns tell it is: headers, channels, events, packets, partitions or any other."""
    own = set(df.columns)
    first = [r.asDict() for r in df.limit(ROWS).collect()]
    if {"file_type", "bytes_in_headers"} <= own:
        kind = "event file header" if "bytes_in_data_packet" in own else "signal file header"
        shown = [", ".join(f"{k}={r[k]}" for k in ("file_type", "file_spec", "time_resolution_timestamp", "period", "channel_count", "bytes_in_data_packet", "comment") if k in r) for r in first]
    elif {"electrode_id", "electrode_label"} <= own or {"original_channel", "sampling_frequency"} <= own:
        kind, shown = "channels", [", ".join(f"{k}={r[k]}" for k in ("electrode_id", "electrode_label", "original_channel", "name", "units", "sampling_frequency", "sample_rate_signal") if k in r) for r in first]
    elif {"time_in_seconds", "timestamp"} <= own:
        kind, shown = "events", [f"{r['time_in_seconds']:.4f} s: {r.get('event', 'spike')}" for r in first]
    elif {"packet_seq", "n_data_points"} <= own:
        kind, shown = "packets", [f"{r['n_data_points']} samples at {r['t_ref']:.4f} s, partition {r['partition']}" for r in first]
    elif {"relative_time", "n_samples"} <= own:
        kind, shown = "partitions", [f"{r['partition']}: {r['n_samples']} samples from {r['relative_time']:.4f} s" for r in first]
    elif "record_seq" in own:
        kind, shown = "header records", [", ".join(f"{k}={v}" for k, v in r.items() if k not in ("original_filename", "record_seq")) for r in first]
    else:
        kind, shown = "table", [", ".join(f"{k}={v}" for k, v in r.items()) for r in first]
    n = df.count()
    more = [f"and {n - len(shown)} more"] if n > len(shown) else []
    return _lines(f"{title or kind}: {n} rows", [*shown, *more])
