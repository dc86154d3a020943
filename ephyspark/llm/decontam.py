"""Benchmark decontamination by a prefix-filtered containment join (operator 4).

A window is `width` consecutive words of a benchmark item (the whole item where it has fewer). Each window is a set of
shingles of up to three words; shingles are ordered by how often they occur in all documents, and as a window must be
contained whole, its prefix is the single rarest shingle. Where that shingle occurs in a document, the positional bound
gives the only place at which the window can start, the length bound rejects places too near the document's ends, and
the 64-bit hash of exactly those words is compared with the window's.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, which bounds every broadcast; each further
block is one more pass that merges its hits into those found before. A block's windows are a few numpy arrays, some dozens of
bytes for each word. Documents are never shuffled.

Defined results: null and empty texts have no words and no hits; null and empty items have no windows; items with equal
ids count once; an item without an id hits words but is in no list of items; repeated rows are judged alike; a very long
text is one pass of its own and as large as a row may be; an empty table gives an empty table; other columns pass through,
and a column with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .core import alnum_table, lower_table, passes, share, text_bytes, window_hashes, word_hashes, words

#: Words of a shingle, and bytes of benchmark text that one pass over the documents handles.
SHINGLE, BLOCK_BYTES = 3, 8 << 20
_LOWER, _WORD = lower_table(), alnum_table()
_BITS = 20


@dataclass
class Tokens:
    hashes: np.ndarray
    first: np.ndarray
    document: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    data, off = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = words(data, off, _WORD)
    return Tokens(word_hashes(data, starts, ends), first, np.repeat(np.arange(len(off) - 1), np.diff(first)))


def shingles(t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of `length` words inside one document."""
    n = len(t.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(t.document[:n] == t.document[length - 1 :])
    return at, window_hashes(t.hashes, length)[at]


class Lookup:
    """Positions of hashes in a sorted array, with a bitmap that rejects most of those which aren't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[keys & np.uint64((1 << _BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into `hashes` that are found and their positions in the keys."""
        maybe = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << _BITS) - 1)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[k] == hashes[maybe]
        return maybe[same], k[same]


@dataclass
class Windows:
    """Distinct windows of a block of items: hash, words, and the items of each in compressed rows."""

    hash: np.ndarray
    length: np.ndarray
    item_off: np.ndarray
    items: np.ndarray
    names: list[str]


def windows_of(ids: list[str | None], texts: list[str], width: int) -> tuple[Windows, Tokens, np.ndarray]:
    """The windows, the block's words, and where among them each window begins (at one of its places)."""
    t = tokens(pa.array(texts, pa.large_string()))
    names = sorted({i for i in ids if i is not None})
    number = {x: k for k, x in enumerate(names)}
    item = np.array([-1 if i is None else number[i] for i in ids], dtype=np.int64)
    size = np.diff(t.first)
    least = np.minimum(size, width)
    at, text = expand(t.first[:-1], t.first[1:] - least + (size > 0))
    n, h = least[text], np.zeros(len(at), dtype=np.uint64)
    for k in np.unique(n).tolist():
        own = n == k
        h[own] = window_hashes(t.hashes, k)[at[own]]
    order = np.lexsort((item[text], h, n))
    at, n, h, item = at[order], n[order], h[order], item[text][order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    once = item >= 0
    once[1:] &= new[1:] | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    counts = np.bincount((np.cumsum(new) - 1)[once], minlength=len(first))
    return Windows(h[first], n[first], np.concatenate([[0], np.cumsum(counts)]), item[once], names), t, at[first]


def _shingle_lengths(w: Windows) -> np.ndarray:
    return np.minimum(w.length, SHINGLE)


def shingle_keys(w: Windows, t: Tokens, at: np.ndarray) -> dict[int, np.ndarray]:
    """The distinct shingles of all windows by their length."""
    out = {}
    q_of = _shingle_lengths(w)
    for q in np.unique(q_of).tolist():
        own = q_of == q
        places, _ = expand(at[own], at[own] + w.length[own] - q + 1)
        out[q] = np.unique(window_hashes(t.hashes, q)[places])
    return out


def count_shingles(df: DataFrame, text: str, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each given shingle occurs in all documents, beside the keys."""
    shared = share(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {q: Lookup(k) for q, k in shared.value.items()}
        counts = {q: np.zeros(len(k), dtype=np.int64) for q, k in shared.value.items()}
        for batch in batches:
            for part in passes(batch, text):
                t = tokens(part.column(text))
                for q, look in lookups.items():
                    _, k = look.find(shingles(t, q)[1])
                    counts[q] += np.bincount(k, minlength=len(counts[q]))
        for q, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, dtype=np.int32)), pa.array(some), pa.array(c[some])], names=["q", "k", "n"])

    got = df.select(text).mapInArrow(run, "q int, k long, n long").groupBy("q", "k").agg(F.sum("n").alias("n")).toArrow()
    q, k, n = (got.column(c).to_numpy() for c in ("q", "k", "n"))
    out = {length: np.zeros(len(x), dtype=np.int64) for length, x in keys.items()}
    for length, c in out.items():
        c[k[q == length]] = n[q == length]
    return out


@dataclass
class Index:
    """Windows under their rarest shingle: by shingle length, sorted shingles, and window numbers with the offset."""

    windows: Windows
    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build_index(w: Windows, t: Tokens, at: np.ndarray, keys: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> Index:
    parts = []
    q_of = _shingle_lengths(w)
    for q, known in keys.items():
        own = np.flatnonzero(q_of == q)
        sh = window_hashes(t.hashes, q)
        rare, least, offset = np.zeros(len(own), dtype=np.int64), np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), dtype=np.int64)
        for o in range(int(w.length[own].max()) - q + 1):
            inside = np.flatnonzero(w.length[own] >= q + o)
            k = np.searchsorted(known, sh[at[own[inside]] + o])
            c = counts[q][k]
            better = (c < least[inside]) | (c == least[inside]) & (k < rare[inside])
            i = inside[better]
            rare[i], least[i], offset[i] = k[better], c[better], o
        order = np.argsort(rare, kind="stable")
        used, start = np.unique(rare[order], return_index=True)
        parts.append((q, known[used], np.append(start, len(order)), own[order], offset[order]))
    return Index(w, parts)


def expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i in the ranges start..end, and which range each comes from."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[which], which


def find(t: Tokens, index: Index, lookups: list[Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """Start words and window numbers of all occurrences."""
    starts, found = [], []
    w = index.windows
    for (q, _, row, number, offset), look in zip(index.parts, lookups, strict=True):
        at, sh = shingles(t, q)
        i, k = look.find(sh)
        j, which = expand(row[k], row[k + 1])
        win, s = number[j], at[i][which] - offset[j]
        e = s + w.length[win]
        doc = t.document[at[i][which]]
        fits = (s >= t.first[doc]) & (e <= t.first[doc + 1])
        s, win = s[fits], win[fits]
        if len(s):
            for n in np.unique(w.length[win]).tolist():
                own = np.flatnonzero(w.length[win] == n)
                same = own[window_hashes(t.hashes, n)[s[own]] == w.hash[win[own]]]
                starts.append(s[same])
                found.append(win[same])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *found])


#: The columns that `mark` adds.
NEW = StructType(
    [
        StructField("n_words", LongType()),
        StructField("hit_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("items", ArrayType(StringType())),
    ]
)


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds n_words, hit_spans (maximal runs of hit words, end exclusive) and items (ids as strings, sorted)."""
    out = source = df.drop(*NEW.names)
    for ids, texts in _blocks(benchmark.select(F.col(item_id).cast("string"), F.coalesce(item_text, F.lit("")))):
        w, t, at = windows_of(ids, texts, width)
        keys = shingle_keys(w, t, at)
        out = _scan(out, text, build_index(w, t, at, keys, count_shingles(source, text, keys)))
    return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[str | None], list[str]]]:
    ids, texts, size, any_yet = [], [], 0, False
    for i, x in items.toLocalIterator():
        if texts and size + len(x.encode()) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size, any_yet = [], [], 0, True
        ids.append(i)
        texts.append(x)
        size += len(x.encode())
    if texts or not any_yet:
        yield ids, texts


def _scan(df: DataFrame, text: str, index: Index) -> DataFrame:
    again = "hit_spans" in df.columns
    shared = share(df, index)
    plain = [f for f in df.schema.fields if not again or f.name not in {x.name for x in NEW}]
    schema = StructType([*plain, *NEW.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [Lookup(p[1]) for p in shared.value.parts]
        for batch in batches:
            for part in passes(batch, text):
                columns = _marked(part, text, shared.value, lookups, again)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in plain), *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def _marked(part: pa.RecordBatch, text: str, index: Index, lookups: list[Lookup], again: bool) -> list[pa.Array]:
    t = tokens(part.column(text))
    start, win = find(t, index, lookups)
    w = index.windows
    step = np.zeros(len(t.hashes) + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + w.length[win], -1)
    doc = t.document[start]
    j, which = expand(w.item_off[win], w.item_off[win + 1])
    pairs = np.unique(doc[which] * max(1, len(w.names)) + w.items[j])  # windows of items without an id have none
    items: list[list[str]] = [[] for _ in range(part.num_rows)]
    for p in pairs.tolist():
        items[p // len(w.names)].append(w.names[p % len(w.names)])
    if again:
        for i, (spans, old) in enumerate(zip(part.column("hit_spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
            items[i] = sorted({*items[i], *old})
            for s in spans:
                step[t.first[i] + s["start"]] += 1
                step[t.first[i] + s["end"]] -= 1
    hit = np.cumsum(step)[:-1] > 0
    spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
    if hit.any():
        new_doc = np.zeros(len(hit), dtype=bool)
        new_doc[t.first[:-1][t.first[:-1] < len(hit)]] = True
        opens = hit & (new_doc | ~np.concatenate([[False], hit[:-1]]))
        closes = hit & np.concatenate([new_doc[1:] | ~hit[1:], [True]])
        for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist(), strict=True):
            d = int(t.document[a])
            spans[d].append({"start": a - int(t.first[d]), "end": b + 1 - int(t.first[d])})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(np.diff(t.first)), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Query op4: windows of ten words over all documents."""
    m = mark(documents.select("doc_id", "text"), benchmark)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return m.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
