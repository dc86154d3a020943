"""Byte-pair encoding and decoding with forced boundaries (operator 5).

A byte pair that stands inside no token of the vocabulary can never be joined by a merge, so a cut between its two
bytes is certain. Every pre-token of the published pattern is cut at such pairs, each fragment is merged on its own and
remembered, and the fragments' ids are concatenated. Caches only save time: they are emptied when full and change no
result, and a fragment of any length is merged in O(n log n).

Defined results: null and empty texts have no ids and decode to the empty text; a special token's own string in a text
becomes its id and decodes to that string; repeated rows are encoded again; other columns pass
through unchanged, and a column with the name of a new one is replaced.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from tokenizers import pre_tokenizers

from .core import passes, share

#: Fixed value: the published pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a cache before it is emptied, and the longest pre-token that is kept, in characters.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
_NONE = 1 << 40


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Token bytes by id, merges by id pair, the special tokens, and which byte pairs stand inside tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        of = byte_of_char()
        vocab = spec["model"]["vocab"]
        self.token = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
        self.base = [0] * 256
        for i, b in self.token.items():
            if len(b) == 1:
                self.base[b[0]] = i
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_of = {i: t for t, i in self.special.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.inside = {b[k : k + 2] for b in self.token.values() for k in range(len(b) - 1)}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None


class _Classes(dict):
    """For str.translate: late code points become early ones of the class that the tokenizers library gives them.

    Libraries follow different Unicode versions; this keeps pre-tokens the same for characters that are new or not
    assigned yet.
    """

    def __init__(self):
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def __missing__(self, c: int) -> int:
        if c < 0x558:
            return c
        ends = lambda before: [x[1] for x in self.split(before + chr(c))] == [(0, 2)]
        self[c] = out = 0xAA if ends("a") else 0xB2 if ends("1") else 0x378 if ends("!") else c
        return out


class _Cache(dict):
    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.late = regex.compile("[^\x00-\u0557]")
        self.classes = _Classes()
        self.fragments = _Cache(self._merge, CACHE_ENTRIES // 8)
        self.pieces = _Cache(self._piece, CACHE_ENTRIES)

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        """Joins the pair of least rank, the leftmost of equals, until no pair has one."""
        ids = [self.v.base[b] for b in fragment]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, made = self.v.rank.get, self.v.made
        ranks = [rank(a << 32 | b, _NONE) for a, b in itertools.pairwise(ids)]
        while ranks and (best := min(ranks)) != _NONE:
            k = ranks.index(best)
            ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 32 | ids[k], _NONE)
            if k < len(ranks):
                ranks[k] = rank(ids[k] << 32 | ids[k + 1], _NONE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a queue and links between neighbours."""
        rank, made = self.v.rank.get, self.v.made
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 32 | ids[k + 1], _NONE)) != _NONE]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            right = after[k]
            if ids[k] < 0 or right < 0 or rank(ids[k] << 32 | ids[right], _NONE) != r:
                continue
            ids[k], ids[right] = made[r], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (r := rank(ids[i] << 32 | ids[j], _NONE)) != _NONE:
                    heapq.heappush(queue, (r, i))
        return tuple(i for i in ids if i >= 0)

    def _piece(self, piece: str) -> tuple[int, ...]:
        b = piece.encode()
        inside = self.v.inside
        cuts = [0, *(k for k in range(1, len(b)) if b[k - 1 : k + 1] not in inside), len(b)]
        if len(cuts) == 2:
            return self._merge(b)  # the piece itself is remembered
        return tuple(itertools.chain.from_iterable(self.fragments[b[s:e]] for s, e in itertools.pairwise(cuts)))

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if not text.isascii() and self.late.search(text) and (same := text.translate(self.classes)) != text:
            return [text[m.start() : m.end()] for m in self.pattern.finditer(same)]
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        if self.v.cut_special is None or not self.v.cut_special.search(text):
            return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))
        out: list[int] = []
        for part in self.v.cut_special.split(text):
            if part in self.v.special:
                out.append(self.v.special[part])
            else:
                out += itertools.chain.from_iterable(map(self.pieces.__getitem__, self.find(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.token.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and vocabulary; workers are used again by later tasks."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(shared.value))
    return _codecs[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return share(df, f.read())


def _mapped(df: DataFrame, shared, column: str, new: dict[str, DataType], make) -> DataFrame:
    """Adds the columns `new`, made from slices of the column; the vocabulary file's size bounds the broadcast."""
    df = df.drop(*new)
    fields = df.schema.names
    schema = StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in passes(batch, column) if pa.types.is_string(batch.schema.field(column).type) else [batch]:
                columns = make(codec, part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*fields, *new])

    return df.mapInArrow(run, schema)


def _id_list(rows: list[list[int]]) -> pa.Array:
    off = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=off[1:])
    flat = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int32, count=int(off[-1]))
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as array<int>."""
    return _mapped(df, _shared(df, path), text, {ids: ArrayType(IntegerType())}, lambda c, col: [_id_list([c.encode(t or "") for t in col.to_pylist()])])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of token ids, special tokens included."""
    return _mapped(df, _shared(df, path), ids, {text: StringType()}, lambda c, col: [pa.array([c.decode(r or []) for r in col.to_pylist()], pa.string())])


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds both, in one pass over the texts."""

    def make(codec: Codec, col: pa.Array) -> list[pa.Array]:
        rows = [codec.encode(t or "") for t in col.to_pylist()]
        return [_id_list(rows), pa.array([codec.decode(r) for r in rows], pa.string())]

    return _mapped(df, _shared(df, path), text, {ids: ArrayType(IntegerType()), decoded: StringType()}, make)


def digest(df: DataFrame, path: str) -> DataFrame:
    """Query op5: token count and digests of each document's ids and decoded text."""
    made = encode_decode(df.select("doc_id", "text"), path, ids="ids_", decoded="decoded_")
    return made.select(
        "doc_id",
        F.size("ids_").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids_").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_").cast("binary"), 256).alias("decoded_sha256"),
    )
