"""MinHash near-duplicate detection by an inverted join of signature coordinates (operator 3).

1. Each document gives its set of word shingles as a size, a 128-bit digest and a signature of COORDINATES minima.
   Documents with equal sets are one class, represented by its least key; only representatives go on.
2. Every (coordinate, value) pair of a representative is a posting. Values that occur once can match nothing. Of the m
   others a document needs `threshold` matches, so it keeps only the m - threshold + 1 rarest: two documents with enough
   matches must meet under one of these (prefix filter), and one with m below the threshold is skipped altogether.
3. Where postings meet, collisions are counted: short lists pair by pair, others first against the list's least member
   and then only where members are still apart, so no list is written out pair by pair. What leaves a list is a forest
   of its matches. A list of more than LIST members is dealt to parts, each with the list's least member; parts that
   still hold several candidate groups are compared with each other.
4. The components of these edges are candidate groups that hold all pairs at or above the threshold. Links are decided on
   full shingle sets (64-bit shingle digests) inside each group, where a member is compared only with those that share one
   of its rarest shingles and aren't yet in its component. A group's texts go to one task, once; a group of more than
   BLOCK shingles is dealt to blocks, first with its least member, and then only the members outside its largest
   component meet the other blocks.

The threshold lies five standard deviations below the expected matches at the wanted similarity (a link is overlooked
with a probability of about 1e-6); there are no caps.

Defined results: null and empty texts have no shingles, link with nothing and are their own component; with fewer words
than a shingle the whole sequence is the one shingle; rows with equal keys are judged each by its own text; rows
with a null key link with nothing, are kept and have a null component; a very long text is one pass of its own and as large
as a row may be; an empty table gives an empty table; only the columns named in near_duplicates are returned, others
are left to a join by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anngraph import Forest
from .components import components
from .core import ensure_checkpoint_dir, lower_table, mix, non_space_table, passes, share, text_bytes, window_hashes, word_hashes, words
from .groups import whole_runs

COORDINATES = 48
#: Members of a list, and shingles of a group, that one task takes at once.
LIST, BLOCK = 4096, 1 << 21
#: Lists of so few members are compared pair by pair.
SHORT = 24
#: Bytes of rows that are read at once, in whole lists or groups.
PASS = 4 << 20
_LOWER, _WORD = lower_table(), non_space_table()
_random = np.random.default_rng(7)
_A = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def threshold_for(similarity: float) -> int:
    k = COORDINATES
    return max(1, math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity))))


def shingle_sets(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each, and where each text's begin (n + 1)."""
    data, off = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = words(data, off, _WORD)
    h = word_hashes(data, starts, ends)
    size = np.diff(first)
    of = np.minimum(size, length)
    counts = np.where(size > 0, size - of + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    text = np.repeat(np.arange(len(size)), counts)
    at = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1] - first[:-1], counts)
    all_h = np.zeros(len(at), dtype=np.uint64)
    for k in np.unique(of[size > 0]).tolist():
        own = of[text] == k
        all_h[own] = window_hashes(h, k)[at[own]]
    out = [np.unique(all_h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, dtype=np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def signatures(df: DataFrame, text: str, key: str, length: int) -> DataFrame:
    """id, n_shingles, the set's digest (hi, lo) and its signature; the last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                u, bounds = shingle_sets(part.column("text"), length)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                digest = np.zeros((2, len(n)), dtype=np.uint64)
                sig = np.zeros((len(n), COORDINATES), dtype=np.uint32)
                if len(some):
                    at = bounds[:-1][some]
                    digest[0, some] = np.add.reduceat(mix(u), at)
                    digest[1, some] = np.add.reduceat(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for k in range(COORDINATES):
                        v = u * _A[k]
                        v += _B[k]
                        sig[some, k] = (mix(np.minimum.reduceat(v, at)) >> np.uint64(32)).astype(np.uint32)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), *(pa.array(d.view(np.int64), mask=none) for d in digest), pa.array([None if x else r.tobytes() for x, r in zip(none.tolist(), sig, strict=True)], pa.binary())],
                    names=["id", "n_shingles", "hi", "lo", "sig"],
                )

    return _keyed(df, text, key).mapInArrow(run, "id long, n_shingles long, hi long, lo long, sig binary")


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A (coordinate, value) token and the representative, for every coordinate."""
    high = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None, :]
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            b = batch.slice(at, 2048)
            tok = (_sig_matrix(b.column("sig")).astype(np.uint64) | high).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.repeat(b.column("rep").to_numpy(), COORDINATES))], names=["tok", "rep"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many coordinates each row of a agrees with the row of b."""
    return np.count_nonzero(a == b, axis=1)


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates on which each row of a agrees with each row of b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] == y
    return out


def _alike(threshold: int, similarity: float, sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether members i and j match often enough and can be as similar by their sizes."""
    out = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
    some = np.flatnonzero(out)
    for at in range(0, len(some), 1 << 14):
        k = some[at : at + (1 << 14)]
        out[k] = _agree(sig[i[k]], sig[j[k]]) >= threshold
    return out


def _rest(threshold: int, similarity: float, sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, code: np.ndarray) -> None:
    """Unites what members `left` match among `right`, comparing only members that the forest still holds apart."""
    for at in range(0, len(left), 128):
        i = left[at : at + 128]
        m = _matches(sig[i], sig[right])
        low, high = np.minimum(n[i][:, None], n[right]), np.maximum(n[i][:, None], n[right])
        x, y = np.nonzero((m >= threshold) & (low >= similarity * high - 1e-9))
        forest.unite(code[i][x], code[right][y])


def _lists(threshold: int, similarity: float):
    def forest_of(tok: np.ndarray, part: np.ndarray, rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> pa.RecordBatch | None:
        """Edges of a forest of each list's matches; rows are whole lists, their least member first."""
        first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(first, len(tok)))
        lead = np.repeat(first, size)
        small = np.repeat(size <= SHORT, size)
        place = np.arange(len(tok)) - lead
        # short lists: each member with all before it; others: with the first
        j = np.flatnonzero(small)
        times = place[j]
        y = np.repeat(j, times)
        x = np.repeat(lead[j], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        k = np.flatnonzero(~small & (place > 0))
        x, y = np.concatenate([x, lead[k]]), np.concatenate([y, k])
        good = _alike(threshold, similarity, sig, n, x, y) & (rep[x] != rep[y])
        forest = Forest(len(tok))
        forest.unite(x[good], y[good])
        own = np.arange(len(tok))
        for s, m in zip(first[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            apart = s + np.flatnonzero(forest.root[s : s + m] != forest.root[s])
            if len(apart):
                _rest(threshold, similarity, sig, n, apart, np.arange(s, s + m), forest, own)
        moved = np.flatnonzero((forest.root != own) & (rep[forest.root] != rep))
        return pa.RecordBatch.from_arrays([pa.array(rep[forest.root[moved]]), pa.array(rep[moved])], names=["a", "b"]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["tok", "part"], PASS // 2):
            out = forest_of(*(t.column(c).to_numpy() for c in ("tok", "part", "rep", "n")), _sig_matrix(t.column("sig")))
            if out:
                yield out

    return run


def _across(threshold: int, similarity: float):
    def run(t: pa.Table) -> pa.Table:
        """Candidate groups that two parts of a list show to be one: an edge for each group that joins another."""
        group, n, left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cand", "n", "left", "right"))
        names, code = np.unique(group, return_inverse=True)
        forest = Forest(len(names))
        _rest(threshold, similarity, _sig_matrix(t.column("sig")), n, np.flatnonzero(left), np.flatnonzero(right), forest, code)
        return _joined(names, forest)

    return run


def _joined(names: np.ndarray, forest: Forest) -> pa.Table:
    moved = np.flatnonzero(forest.root != np.arange(len(names)))
    return pa.table([pa.array(names[forest.root[moved]]), pa.array(names[moved])], names=["a", "b"])


def postings_of(reps: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """Prefix postings (tok, part, rep, n, sig), parts of one list each, and the long lists (tok, lead, parts).

    Postings of a value are counted by partial sums, and a value's count joins its postings row by row, so a hot value is
    no task's burden: adaptive execution splits that join.
    """
    tokens = reps.select("rep", "sig").mapInArrow(_tokens, "tok long, rep long")
    counts = tokens.groupBy("tok").agg(F.count("*").alias("df"), F.min("rep").alias("lead")).where("df > 1")
    of_rep = Window.partitionBy("rep")
    shared = tokens.join(counts.select("tok", "df"), "tok")
    ranked = shared.withColumn("m", F.count("*").over(of_rep)).where(F.col("m") >= need).withColumn("r", F.row_number().over(of_rep.orderBy("df", "tok")))
    prefix = ranked.where(F.col("r") <= F.col("m") - need + 1).select("tok", "df", "rep")
    parts = F.ceil(F.col("df") / LIST).cast("int")
    prefix = prefix.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).select("tok", "part", "rep")
    long = counts.where(F.col("df") > LIST).select("tok", "lead", parts.alias("parts"))
    return prefix.join(reps, "rep").select("tok", "part", "rep", "n", "sig"), long


def candidate_groups(reps: DataFrame, need: int, similarity: float) -> DataFrame:
    """(id, component) of representatives that match, each with the least one it reaches by matches."""
    postings, long = postings_of(reps, need)
    postings = postings.checkpoint()
    long = long.checkpoint()
    leads = long.select("tok", F.col("lead").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(reps, "rep")
    lists = postings.union(leads.select("tok", "part", "rep", "n", "sig")).repartition("tok", "part").sortWithinPartitions("tok", "part", "rep")
    edges = lists.mapInArrow(_lists(need, similarity), "a long, b long").distinct().checkpoint()
    groups = components(edges)
    if not long.take(1):
        return groups
    more = _open(postings, long, groups).groupBy("tok", "i", "j").applyInArrow(_across(need, similarity), "a long, b long").distinct().checkpoint()
    return components(edges.union(more)) if more.take(1) else groups


def _open(postings: DataFrame, long: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of long lists with several candidate groups: those outside the largest group, against all the list's parts."""
    p = postings.join(long, "tok").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    p = p.select("tok", F.col("part").alias("j"), "parts", "rep", "n", "sig", F.coalesce("component", "rep").alias("cand"))
    return _against(p, ["tok"], F.lit(1), LIST, ["rep", "n", "sig"], "cand")


def _against(rows: DataFrame, by: list[str], weight, most: int, carried: list[str], group: str) -> DataFrame:
    """Of rows (by, part j of parts, group) whose `by` hold several groups: (by, i, j, carried, group, left, right).

    Rows outside the largest group are dealt to parts i of about `most` in weight and sent to every part j, marked left;
    each row stays in its own part j, marked right, once for every i.
    """
    per = rows.groupBy(*by, group).agg(F.sum(weight).alias("w"))
    main = per.groupBy(*by).agg(F.max_by(group, F.struct("w", -F.col(group))).alias("main_"), F.count("*").alias("k"), (F.sum("w") - F.max("w")).alias("rest")).where("k > 1")
    rows = rows.join(main.withColumn("lefts", F.ceil(F.col("rest") / most).cast("int")), by)
    part = F.pmod(F.xxhash64(carried[0], F.lit(1)), F.col("lefts")).cast("int")
    left = rows.where(F.col(group) != F.col("main_")).select(*by, part.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), *carried, group, F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = rows.select(*by, F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), "j", *carried, group, F.lit(False).alias("left"), F.lit(True).alias("right"))
    return left.union(right)


def link_sets(u: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, code: np.ndarray, forest: Forest, percent: int) -> None:
    """Unites the codes of members whose sets (u between bounds) are linked, comparing rows `left` with rows `right`.

    Shingles are ordered by how often they occur here. A linked pair shares at least `percent` of either set, so it shares
    one of the rarest of the left one's; only members found under these, not yet united and of a fitting size, are counted.
    """
    _, inv, often = np.unique(u, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    word, size = rank[inv], np.diff(bounds)
    member = np.repeat(np.arange(len(size)), size)
    inside = np.zeros(len(size), dtype=bool)
    inside[right] = True
    place = np.flatnonzero(inside[member])
    place = place[np.argsort(word[place], kind="stable")]
    row = np.concatenate([[0], np.cumsum(np.bincount(word[place], minlength=len(often)))])
    owner = member[place]
    mark = np.zeros(len(often), dtype=bool)
    for x in left.tolist():
        own = np.sort(word[bounds[x] : bounds[x + 1]])
        n = len(own)
        rare = own[: n - -(-percent * n // 100) + 1]
        _, found = _ranges(row[rare], row[rare + 1])
        y = owner[found]
        y = y[(forest.root[code[y]] != forest.root[code[x]]) & (100 * np.minimum(size[y], n) >= percent * np.maximum(size[y], n))]
        if not len(y):
            continue
        y = np.unique(y)
        mark[own] = True
        which, at = _ranges(bounds[y], bounds[y + 1])
        both = np.bincount(which, weights=mark[word[at]], minlength=len(y)).astype(np.int64)
        mark[own] = False
        near = y[100 * both >= percent * (n + size[y] - both)]
        forest.unite(np.full(len(near), code[x]), code[near])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each comes from, and all places in the ranges start..end."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[which]


def _sets(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    u, bounds = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for part in passes(t.select(["text"]), "text"):
        h, b = shingle_sets(part.column("text"), length)
        u.append(h)
        bounds.append(b[1:] + bounds[-1][-1])
    return np.concatenate(u), np.concatenate(bounds)


def _whole_groups(length: int, percent: int):
    def solve(t: pa.Table) -> pa.RecordBatch:
        """The component of every member of some whole groups; rows are sorted by group."""
        u, bounds = _sets(t, length)
        ids, group = t.column("id").to_numpy(), t.column("cand").to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            names, code = np.unique(ids[a:b], return_inverse=True)
            forest, own = Forest(len(names)), np.arange(b - a)
            link_sets(u[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], own[1:], own, code, forest, percent)
            out.append((names, names[forest.root]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["cand"], PASS):
            yield solve(t)

    return run


def _block(length: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Components that a block's members show to be linked, as edges between component ids."""
        u, bounds = _sets(t, length)
        names, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        forest = Forest(len(names))
        link_sets(u, bounds, left, right, comp, forest, percent)
        return _joined(names, forest)

    return run


def links_within(groups: DataFrame, sizes: DataFrame, df: DataFrame, text: str, key: str, length: int, percent: int) -> DataFrame:
    """(id, component) by exact links inside candidate groups (id, component); sizes has each id's shingles `n`."""
    m = groups.select("id", F.col("component").alias("cand")).join(sizes, "id")
    m = m.join(m.groupBy("cand").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")), "cand").checkpoint()
    texts = _filtered(_keyed(df, text, key), m.select("id"))
    small = m.where("parts = 1").select("id", "cand").join(texts, "id").repartition("cand").sortWithinPartitions("cand", "id")
    out = small.mapInArrow(_whole_groups(length, percent), "id long, component long")
    large = m.where("parts > 1")
    if not large.take(1):
        return out
    return out.union(_large_groups(large, texts, length, percent))


def _large_groups(m: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """The same for groups of several blocks: each block with the group's least member, then what is apart against all."""
    m = m.withColumn("j", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).checkpoint()
    hub = m.where("id = cand").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cand", "j", "id")
    yes = F.lit(True)
    first = m.select("cand", "j", "id").union(hub).distinct().select("cand", F.col("j").alias("i"), "j", "id", F.col("id").alias("comp"), yes.alias("left"), yes.alias("right"))
    solve = lambda rows: rows.join(texts, "id").groupBy("cand", "i", "j").applyInArrow(_block(length, percent), "a long, b long")
    links = solve(first).checkpoint()
    apart = m.join(components(links), "id", "left").select("cand", "j", "parts", "id", "n", F.coalesce("component", "id").alias("comp"))
    second = _against(apart, ["cand"], F.col("n"), BLOCK, ["id"], "comp").checkpoint()
    if second.take(1):
        links = links.union(solve(second))
    return components(links)


#: Bits of the filter that keeps texts which no pair needs out of the shuffle; 1 MB whatever the input's size.
FILTER_BITS = 1 << 23


def _filtered(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among the ids: a bitmap of fixed size, made in parts; when it is full all rows pass."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words_ = ids.select(bit("id").alias("bit")).select(F.floor(F.col("bit") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 AS int)) AS m"))
    got = words_.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[got.w.to_numpy()] = got.m.to_numpy()
    shared = share(texts, table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("bit").to_numpy()
            yield b.filter(pa.array((shared.value[k // 64] >> (k % 64).astype(np.uint64)) & np.uint64(1) > 0)).select(["id", "text"])

    return texts.where("id IS NOT NULL").withColumn("bit", bit("id")).mapInArrow(run, texts.schema)


def near_duplicates(df: DataFrame, similarity: float = 0.8, length: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key reachable by links) and kept (whether that is its own)."""
    ensure_checkpoint_dir(df.sparkSession)
    need, percent = threshold_for(similarity), round(100 * similarity)
    s = signatures(df, text, key, length).checkpoint()
    some = s.where("n_shingles > 0 AND id IS NOT NULL")
    reps = some.groupBy("hi", "lo", "n_shingles").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")).checkpoint()
    classes, reps = reps.drop("sig"), reps.select("rep", F.col("n_shingles").alias("n"), "sig")
    groups = candidate_groups(reps, need, similarity)
    sizes = reps.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n"))
    comp = links_within(groups, sizes, df, text, key, length, percent).select(F.col("id").alias("rep"), "component")
    reach = classes.join(comp, "rep", "left").select("hi", "lo", "n_shingles", F.coalesce("component", "rep").alias("reach"))
    out = s.join(reach, ["hi", "lo", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("reach", "id")).alias("reach"))
    return out.select(F.col("id").alias(key), "n_shingles", F.col("reach").alias("component_id"), F.coalesce(F.col("reach") == F.col("id"), F.lit(True)).alias("kept"))


def digest(documents: DataFrame) -> DataFrame:
    """Query op3: five words, 100 * intersection >= 85 * union."""
    return near_duplicates(documents, 0.85)
