"""Exact removal of repeated word windows with a count-min prefilter (operator 1).

A window is `width` consecutive words of one document. Every word covered by a window whose words also start earlier in
the corpus is removed; windows are judged on the input.

Documents are dealt once into groups of a few megabytes by a hash of their key. Inside a group repeated windows are
found exactly, which also reduces any hot passage to one row per group. Across groups:

1. A window is represented by its minimizer, the least hash among its `GRAM`-word runs; equal windows have equal
   minimizers. Each group makes a partition sketch: in each of `DEPTH` rows, the cells that its minimizers touch. The
   sketches are merged block by block by addition, so a counter says in how many groups, at most, a
   minimizer occurs (it overestimates, never the reverse), and each group is told which of its cells count two or more,
   and which count `HOT` or more. No task and no driver holds the sketch: its width follows the input's size and its
   blocks are spread over tasks.
2. Only windows estimated to occur in two groups go on. They are grouped exactly, by minimizer and window hash (64 bits
   each), in order of document and place; all but the first are reported back to their group. The windows of a hot
   minimizer are split over `PARTS` parts by their hash, in which equal windows still meet.

Each step is one pass over the dealt documents, whose exchange Spark reuses, so texts are shuffled once.

Defined results: null and empty texts and texts shorter than a window lose nothing; rows with equal keys are one group's
neighbours and count as consecutive, ordered by text; rows with a null key precede all others, in the order of a hash of their
text; a very long text is one pass of its own and as large as a row may be; an empty table gives an empty table; other
columns pass through, and a column with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .core import non_space_table, passes, renamed, text_bytes, window_hashes, word_hashes, words
from .core import mix as mixed
from .groups import binary_slices, deal, flat_binary, runs

GRAM, DEPTH = 8, 2
#: Bytes of a group of documents as stored.
GROUP_BYTES = 5 << 19
#: Cells of a sketch's block at least, and blocks of a row of the sketch at most.
BLOCK, BLOCKS = 1 << 16, 1 << 11
#: Groups that a minimizer must occur in to be split, and the parts that it is split into.
HOT, PARTS = 32, 256
_WORD = non_space_table()


class Group:
    """The windows of a group's documents, in order of key and text."""

    def __init__(self, table: pa.Table, key: str, text: str, width: int):
        if table.num_rows > 1:
            by = [(key, "ascending"), (text, "ascending")]
            table = table.take(pc.sort_indices(table.select([key, text]), by, null_placement="at_start")).combine_chunks()
        self.table = table
        self.width = width
        hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for part in passes(self.table.select([text]), text):
            data, off = text_bytes(part.column(text))
            starts, ends, first = words(data, off, _WORD)
            hashes.append(word_hashes(data, starts, ends))
            counts.append(np.diff(first))
        h = np.concatenate(hashes)
        self.n_words = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        document = np.repeat(np.arange(len(self.n_words), dtype=np.int32), self.n_words)
        n = len(h) - width + 1
        at = np.flatnonzero(document[:n] == document[width - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        self.at = at
        self.row = document[at]
        self.hash = window_hashes(h, width)[at]
        self.minimizer = np.zeros(0, dtype=np.uint64)
        if len(at):
            least, reach, want = window_hashes(h, GRAM), 1, width - GRAM + 1
            while reach < want:
                step = min(reach, want - reach)
                least = np.minimum(least[: len(least) - step], least[step:])
                reach += step
            self.minimizer = least[at]
        # the first place of each window in the group; rows are in order, so the first place is the least index
        order = np.argsort(self.hash, kind="stable")
        same = np.zeros(len(at), dtype=bool)
        a, b = order[:-1], order[1:]
        same[b] = (self.hash[a] == self.hash[b]) & (self.minimizer[a] == self.minimizer[b])
        self.again = same

    def cells(self, minimizers: np.ndarray, cells: int) -> list[np.ndarray]:
        """The cell of each minimizer in each row of the sketch; row r has the numbers from r * cells on."""
        return [(mixed(minimizers + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(cells - 1)).astype(np.int64) + r * cells for r in range(DEPTH)]


def _merge_blocks(size: int, dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the sketches of each block and answers every group: 1 for each of its cells that counts two, 2 for HOT."""
        for t in runs(batches, "block"):
            cells, n = flat_binary(t.column("cells"), dtype)
            count = np.bincount(cells, minlength=size)
            many = (count >= 2).astype(np.uint8) + (count >= HOT)
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks(), t.column("block").combine_chunks(), binary_slices(many[cells], np.concatenate([[0], np.cumsum(n)]))], names=["g", "block", "many"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that are not the first of their kind; rows come in order of minimizer, part, document and place."""
    last, seen = None, np.zeros(0, dtype=np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        h, n = flat_binary(b.column("hashes"), np.uint64)
        take = lambda name: b.column(name).to_numpy(zero_copy_only=False)
        m = np.repeat(take("m").view(np.uint64) ^ take("part").astype(np.uint64), n)  # a hash by its part: one list of windows
        g, r = np.repeat(take("g"), n), np.repeat(take("r"), n)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(take("pos"), n)
        order = np.argsort(h ^ m * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        a, c = order[:-1], order[1:]
        late = np.zeros(len(h), dtype=bool)
        late[c] = (h[a] == h[c]) & (m[a] == m[c])
        if last is not None and (own := m == last).any():
            late[own] |= np.isin(h[own], seen)
        end = m == m[-1]
        seen = np.union1d(seen, h[end]) if m[-1] == last else np.unique(h[end])
        last = m[-1]
        i = np.flatnonzero(late)
        if len(i):
            new = np.ones(len(i), dtype=bool)
            new[1:] = (g[i][1:] != g[i][:-1]) | (r[i][1:] != r[i][:-1]) | (pos[i][1:] != pos[i][:-1] + 1)
            s = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (g[i][s], r[i][s], pos[i][s], np.diff(np.append(s, len(i)))))], names=["g", "r", "pos", "n"])


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 20, kept: str = "kept") -> DataFrame:
    """Adds n_words, n_removed and the kept words joined by one space."""
    if width < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    df, names = renamed(df, {"n_words", "n_removed", kept})
    text, key = names[text], names[key]
    dealt, _, size = deal(df, text, key, GROUP_BYTES)
    cells = 1 << max(16, (size // 4).bit_length())
    block = max(BLOCK, cells // BLOCKS)
    dtype = np.uint16 if block <= 1 << 16 else np.uint32

    def sketch(table: pa.Table) -> pa.Table:
        group = Group(table, key, text, width)
        used = np.unique(np.concatenate(group.cells(np.unique(group.minimizer), cells)))
        blocks, first = np.unique(used // block, return_index=True)
        data = binary_slices((used % block).astype(dtype), np.append(first, len(used)))
        g = pa.array(np.full(len(blocks), table.column("g")[0].as_py(), dtype=np.int32))
        return pa.table([g, pa.array(blocks), data], names=["g", "block", "cells"])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["m", "part", "key", "r", "pos", "g", "hashes"]
        group = Group(left, key, text, width) if left.num_rows else None
        if group is None or not len(group.at):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())], names=names)
        m, back = np.unique(group.minimizer, return_inverse=True)
        by_row = group.cells(m, cells)
        used = np.unique(np.concatenate(by_row))
        many, _ = flat_binary(right.sort_by("block").column("many"), np.uint8)
        level = np.min([many[np.searchsorted(used, c)] for c in by_row], axis=0)[back]
        i = np.flatnonzero((level > 0) & ~group.again)
        part = np.where(level[i] > 1, 1 + (group.hash[i] % np.uint64(PARTS)).astype(np.int32), 0).astype(np.int32)
        new = np.ones(len(i), dtype=bool)
        new[1:] = (np.diff(group.at[i]) != 1) | (np.diff(back[i]) != 0) | (np.diff(group.row[i]) != 0) | (np.diff(part) != 0)
        s = np.flatnonzero(new)
        row, at = group.row[i][s], group.at[i][s]
        keys = group.table.column(key).cast(pa.int64()).fill_null(-(2**63)).to_numpy()
        columns = [pa.array(m[back[i][s]].view(np.int64)), pa.array(part[s]), pa.array(keys[row]), pa.array(row.astype(np.int32)), pa.array((at - group.first[row]).astype(np.int32))]
        g = pa.array(np.full(len(s), left.column("g")[0].as_py(), dtype=np.int32))
        return pa.table([*columns, g, binary_slices(group.hash[i], np.append(s, len(i)))], names=names)

    fields = df.schema.fields
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], left.schema.field(f.name).type) for f in fields] + [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())], names=schema.names)
        group = Group(left, key, text, width)
        step = np.zeros(int(group.first[-1]) + 1, dtype=np.int64)
        own = group.at[group.again]
        np.add.at(step, own, 1)
        np.add.at(step, own + width, -1)
        if right.num_rows:
            r, pos, n = (right.column(c).to_numpy() for c in ("r", "pos", "n"))
            np.add.at(step, group.first[r] + pos, 1)
            np.add.at(step, group.first[r] + pos + n - 1 + width, -1)
        gone = np.cumsum(step)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[group.first[1:]] - total[group.first[:-1]]
        texts, i = [], 0
        for part in passes(group.table.select([text]), text):
            for x in part.column(text).to_pylist():
                w = (x or "").encode().split()
                if removed[i]:
                    w = compress(w, (~gone[group.first[i] : group.first[i + 1]]).tolist())
                texts.append(b" ".join(w).decode())
                i += 1
        return pa.table([*(group.table.column(f.name) for f in fields), pa.array(group.n_words), pa.array(removed), pa.array(texts, pa.string())], names=schema.names)

    sketches = dealt.groupBy("g").applyInArrow(sketch, "g int, block long, cells binary")
    answers = sketches.repartition("block").sortWithinPartitions("block", "g").mapInArrow(_merge_blocks(block, dtype), "g int, block long, many binary")
    exact = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(candidates, "m long, part int, key long, r int, pos int, g int, hashes binary")
    later = exact.repartition("m", "part").sortWithinPartitions("m", "part", "key", "g", "r", "pos").mapInArrow(_later, "g int, r int, pos int, n int")
    out = dealt.groupBy("g").cogroup(later.groupBy("g")).applyInArrow(finish, schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", "n_removed", F.col("kept").alias(kept))


def digest(documents: DataFrame) -> DataFrame:
    """Query op1: windows of twenty words over all documents."""
    out = remove_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
