"""Text, number and bit functions of the recording formats, as Column expressions where SQL can express them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_CONNECTORS = "-:|"


def parse_svec(text: Column, sep: str = ",", connect: str = _CONNECTORS, sort: bool = False, unique: bool = True) -> Column:
    """Index text to array<bigint>: "1-3,5" is [1, 2, 3, 5]; ranges may descend, tokens that are no numbers are dropped."""
    own = "".join(re.escape(c) for c in dict.fromkeys(connect))
    tokens = F.filter(F.transform(F.split(text, re.escape(sep)), lambda x: F.trim(x)), lambda t: t.rlike(f"^[0-9 {own}]+$"))

    def numbers(t: Column) -> Column:
        ends = F.transform(F.filter(F.transform(F.split(t, f"[{own}]"), lambda x: F.trim(x)), lambda e: e.rlike("^[0-9]+$")), lambda e: e.cast("bigint"))
        one = F.when(F.trim(t).rlike("^[0-9]+$"), F.array(F.trim(t).try_cast("bigint")))
        many = F.when(F.size(ends) >= 2, F.sequence(F.element_at(ends, 1), F.element_at(ends, 2)))
        return F.coalesce(F.when(t.rlike(f"[{own}]"), many).otherwise(one), F.array().cast("array<bigint>"))

    out = F.flatten(F.transform(tokens, numbers))
    out = F.array_distinct(out) if unique else out
    return F.array_sort(out) if sort else out


def expand_svec(text: str, sep: str = ",", connect: str = _CONNECTORS) -> list[int]:
    """`parse_svec` of one text, on the driver."""
    out: dict[int, None] = {}
    for token in text.split(sep):
        ends = [int(e) for e in re.split(f"[{re.escape(connect)}]", token.strip()) if re.fullmatch(r"\s*[0-9]+\s*", e)]
        if re.search(f"[{re.escape(connect)}]", token):
            if len(ends) >= 2:
                step = 1 if ends[1] >= ends[0] else -1
                out |= dict.fromkeys(range(ends[0], ends[1] + step, step))
        else:
            out |= dict.fromkeys(ends)
    return list(out)


def deparse_svec(numbers: Column, connect: str = "-", collapse: str = ",", max_lag: int = 1) -> Column:
    """array<bigint> to index text: islands whose steps are at most max_lag become ranges."""
    a = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    lag = max(1, max_lag)
    firsts = F.filter(a, lambda x, i: (i == 0) | (x - F.get(a, i - 1) > lag))
    lasts = F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1) - x > lag))
    ranges = F.zip_with(firsts, lasts, lambda s, e: F.when(s == e, s.cast("string")).otherwise(F.concat_ws(connect, s.cast("string"), e.cast("string"))))
    return F.array_join(ranges, collapse)


def time_origin_text(ts: Column) -> Column:
    """Acquisition time as the format writes it, without a dash between month and day."""
    return F.date_format(ts, "yyyy-MMdd'T'HH:mm:ss.SSS")


def time_origin_of(origin: Column) -> Column:
    """The same text from a header's time_origin struct."""
    g = origin.getField
    return F.format_string("%04d-%02d%02dT%02d:%02d:%02d.%03d", *(g(n) for n in ("Year", "Month", "Day", "Hour", "Minute", "Second", "Millisecond")))


def time_origin_timestamp(origin: Column) -> Column:
    """A header's time_origin struct as a timestamp."""
    g = origin.getField
    return F.make_timestamp(g("Year"), g("Month"), g("Day"), g("Hour"), g("Minute"), g("Second") + g("Millisecond") / 1000)


def channel_name(electrode: Column, label: Column) -> Column:
    """The label, with -%03d appended unless it ends with the electrode's number."""
    return F.when(F.endswith(label, electrode.cast("string")), label).otherwise(F.format_string("%s-%03d", label, electrode))


def channel_filename(electrode: Column, label: Column, suffix: str = ".h5") -> Column:
    return F.concat(channel_name(electrode, label), F.lit(suffix))


def bit_flags(x: Column) -> Column:
    """The eight lowest bits as "00 01 ...", least significant first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.getbit(x, i).cast("string"), 2, "0")), " ")


def unsigned(content: Column, start: int, width: int) -> Column:
    """The little-endian unsigned number of `width` bytes (at most 7) at a 1-based position of a binary column."""
    digits = [F.hex(F.substring(content, start + k, 1)) for k in reversed(range(width))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def file_kind(content: Column) -> Column:
    """"nev" or "nsx" from a file's first bytes; an error for anything else."""
    magic = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    return F.when(magic.isin("NEURALEV", "BREVENTS"), "nev").when(magic.isin("BRSMPGRP", "NEURALCD", "NEURALSG"), "nsx").otherwise(F.raise_error(F.concat(F.lit("unknown file type "), magic)))


def file_version(content: Column) -> Column:
    return F.concat_ws(".", unsigned(content, 9, 1), unsigned(content, 10, 1))


def file_extension(path: Column) -> Column:
    """What follows the last dot of a path's last part; empty without a dot."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]+)$", 1)


def strip_recording_suffix(path: Column) -> Column:
    """A recording's prefix: the path without .nev or .nsN."""
    return F.regexp_replace(path, r"(?i)\.(nev|ns[1-9])$", "")


def str_match(text: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


_ESCAPE = re.compile(rb"%(%|[0-9a-fA-F]{0,2})")


def decode_percent(x: str | None, nil: str = "", compat: bool = True) -> str | None:
    """Percent decoding: %% is %, %HH a byte; %00, and an escape with fewer digits, is `nil`.

    In compat mode an escape that is complete exactly at the end of the text is `nil` too.
    """
    if x is None:
        return None
    raw, none = x.split("\0", 1)[0].encode(), nil.encode()

    def one(m: re.Match) -> bytes:
        e = m[1]
        if e == b"%":
            return b"%"
        if len(e) < 2 or compat and m.end() == len(raw):
            return none
        return bytes([v]) if (v := int(e, 16)) else none

    out = _ESCAPE.sub(one, raw)
    try:
        return out.decode()
    except UnicodeDecodeError:
        return out.decode("latin-1")


def percent_decode(text: Column, nil: str = "", compat: bool = True) -> Column:
    """`decode_percent` of a column; only texts with an escape or a NUL go through Python."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode_percent(x, nil, compat), na_action="ignore")

    coded = text.contains("%") | text.contains("\0")
    return F.when(coded, run(F.when(coded, text))).otherwise(text)


def trim_value(x: str, compat: bool = False) -> str:
    """Trims spaces; compat mode never keeps a first character when cutting at the end."""
    x = x.lstrip(" ")
    if not compat:
        return x.rstrip(" ")
    end = len(x) - 1
    while end > 0 and x[end] == " ":
        end -= 1
    return x[: end + 1] if end > 0 else ""
