"""Embedding near-dedup on a robust-pruned flat graph (operator 10).

Equal vectors of one label are a class, represented by its least id, so copies cost nothing further. Representatives
are dealt to regions (nearest of a label's centroids, fitted on a bounded sample), and one task indexes a region:

1. The region's vectors are clustered into shards of about SHARD, each vector going to its OVERLAP nearest clusters.
2. In a shard every vector's nearest candidates are robust-pruned: a candidate is dropped if a chosen neighbour is ALPHA
   times nearer to it than the vector itself. Shards' adjacency lists and their reverses are united into one flat graph.
3. Queries start at the shards' medoids and follow the graph greedily with a beam; then the search expands from every
   vector found within the range until no new one within it turns up.
4. Pairs within the range are verified in double precision.

Every vector is a query in each region that may hold a partner: not further from the region's centroid than the region's
widest angle and the range together (nor nearer than its narrowest less the range), and within the range of the plane that
divides the region from the vector's own. These bounds lose no pair. Regions of many vectors or queries are dealt to several
tasks by parts and slices. Recall is audited by brute force on bounded samples of queries, random ones and ones known to have
links, against all vectors, per link and per query; below WANTED the search runs again with a doubled beam, and then (at once
if the samples have no link) it compares each query with all vectors of its regions. A task emits one row per linked
vector, its count of links and its local component, so a group of m near copies makes m rows for each region it is searched in.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths never link; rows with equal ids are separate vectors that count one another; a row without an id
has no links, a null component and is kept; an empty table gives no rows; only the columns named in near_duplicates are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .components import components
from .core import ensure_checkpoint_dir, mix, share
from .decontam import expand

#: Vectors of a region at least, regions at most (centroids are twice as many at most), and vectors that fit them.
REGION, REGIONS, SAMPLE = 3000, 8192, 50_000
SHARD, OVERLAP, CANDIDATES, DEGREE, ALPHA = 400, 2, 64, 24, 1.2
BEAM, AUDIT_ROWS, WANTED = 24, 500, 0.98
#: Nearest regions that a vector is always searched in, besides all those that may hold a partner.
PROBES = 3
#: Queries of a region that one task takes, about, and similarities to centroids that are computed at once.
QUERIES, TABLE = 30_000, 1 << 21
#: Queries that are searched at once, and marks of visited nodes that they may take.
BATCH, VISITED = 256, 1 << 26


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of unit vectors; ties and empty clusters keep the result deterministic."""
    if k <= 1 or len(x) <= k:
        return x[:k].copy() if len(x) else x
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        some = size > 0
        c[some] = total[some] / size[some, None]
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) among the vectors of one shard."""
    n = len(x)
    if n < 2:
        return []
    distance = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(distance, np.inf)
    m = min(CANDIDATES, n - 1)
    near = np.argpartition(distance, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, axis=1), axis=1, kind="stable"), axis=1)
    own = np.take_along_axis(distance, near, axis=1)
    alive, taken, edges = np.ones((n, m), dtype=bool), np.zeros(n, dtype=np.int64), []
    for j in range(m):
        chosen = np.flatnonzero(alive[:, j] & (taken < degree))
        if not len(chosen):
            continue
        to = near[chosen, j]
        edges.append((chosen, to))
        taken[chosen] += 1
        between = distance[to[:, None], near[chosen]]
        alive[chosen] &= (ALPHA * between > own[chosen]) | (near[chosen] == to[:, None])
    return edges


class Graph:
    """The united adjacency lists of a region's shards, in compressed rows, and the shards' medoids."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = x
        centroids = kmeans(x[:: max(1, n // 5000)], math.ceil(n / SHARD))
        overlap = min(OVERLAP, len(centroids))
        near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :overlap]
        source, target, medoids = [], [], []
        for s in range(len(centroids)):
            members = np.flatnonzero((near == s).any(axis=1))
            if not len(members):
                continue
            medoids.append(members[np.argmax(x[members] @ centroids[s])])
            for part in _chunks(x, members):
                for a, b in robust_prune(x[part]):
                    source.append(part[a])
                    target.append(part[b])
        self.medoids = np.unique(np.array(medoids, dtype=np.int64))
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (source, target))
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.to = pairs % max(n, 1)
        self.off = np.searchsorted(pairs // max(n, 1), np.arange(n + 1))

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours, and which of the nodes each belongs to."""
        at, which = expand(self.off[nodes], self.off[nodes + 1])
        return self.to[at], which

    def search(self, q: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a similarity of `reach` or more that the search finds."""
        n, rows = len(self.x), np.arange(len(q))
        visited = np.zeros((len(q), n), dtype=bool)
        visited[:, self.medoids] = True
        start = q @ self.x[self.medoids].T
        width = max(beam, len(self.medoids))
        ids, sims, open_ = np.zeros((len(q), width), dtype=np.int64), np.full((len(q), width), -np.inf), np.zeros((len(q), width), dtype=bool)
        k = len(self.medoids)
        ids[:, :k], sims[:, :k], open_[:, :k] = self.medoids, start, True
        hits = [(rows[i], self.medoids[j]) for i, j in [np.nonzero(start >= reach)]]
        while True:
            best = np.where(open_, sims, -np.inf)
            j = np.argmax(best, axis=1)
            live = np.flatnonzero(best[rows, j] > -np.inf)
            if not len(live):
                break
            open_[live, j[live]] = False
            node, which = self.neighbours(ids[live, j[live]])
            query = live[which]
            new = ~visited[query, node]
            node, query = node[new], query[new]
            if not len(node):
                continue
            visited[query, node] = True
            s = np.einsum("ij,ij->i", q[query], self.x[node])
            far = s >= reach
            hits.append((query[far], node[far]))
            first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            sizes = np.diff(np.append(first, len(query)))
            slot = np.arange(len(query)) - np.repeat(first, sizes)
            own = query[first]
            wide_i, wide_s = np.zeros((len(own), int(sizes.max())), dtype=np.int64), np.full((len(own), int(sizes.max())), -np.inf)
            row = np.repeat(np.arange(len(own)), sizes)
            wide_i[row, slot], wide_s[row, slot] = node, s
            all_i, all_s = np.concatenate([ids[own], wide_i], axis=1), np.concatenate([sims[own], wide_s], axis=1)
            all_o = np.concatenate([open_[own], wide_s > -np.inf], axis=1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[own], sims[own], open_[own] = (np.take_along_axis(v, keep, axis=1) for v in (all_i, all_s, all_o))
        query, node = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in zip(*hits, strict=True))
        found = [(query, node)]
        while len(query):
            to, which = self.neighbours(node)
            pair = np.unique(query[which] * n + to)
            a, b = pair // n, pair % n
            new = ~visited[a, b]
            a, b = a[new], b[new]
            visited[a, b] = True
            near = np.einsum("ij,ij->i", q[a], self.x[b]) >= reach
            query, node = a[near], b[near]
            found.append((query, node))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _chunks(x: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """The members; too many for one distance matrix, overlapping windows of them along a fixed direction."""
    if len(members) <= 4 * SHARD:
        return [members]
    direction = np.random.default_rng(5).standard_normal(x.shape[1])
    order = members[np.argsort(x[members] @ direction, kind="stable")]
    return [order[s : s + 2 * SHARD] for s in range(0, len(order) - SHARD, SHARD)]


class Forest:
    """Least member of each set under unions of many pairs at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _scan(u: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, node) with a similarity of `reach` or more."""
    return np.nonzero(q @ u.T >= reach)


def _region(similarity: float, beam: int | None):
    def run(t: pa.Table) -> pa.Table:
        """Linked vectors: id, weight of the vectors linked to a query in this task, and local component; no beam scans all."""
        x = _matrix(t.column("v"), t.num_rows)
        ids, weight, home, query = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "w", "home", "query"))
        order = np.argsort(ids, kind="stable")
        x, ids, weight, home, query = x[order], ids[order], weight[order], home[order], query[order]
        norm, u = np.linalg.norm(x, axis=1), _unit(x)
        nodes, asked = np.flatnonzero(home), np.flatnonzero(query)
        forest, n = Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
        if len(nodes):
            graph = Graph(u[nodes]) if beam else None
            step = max(8, min(BATCH, VISITED // len(nodes)))
            for s in range(0, len(asked), step):
                some = asked[s : s + step]
                q, v = graph.search(u[some], similarity - 1e-6, beam) if beam else _scan(u[nodes], u[some], similarity - 1e-6)
                q, v = some[q], nodes[v]
                ok = (np.einsum("ij,ij->i", x[q], x[v]) / (norm[q] * norm[v]) >= similarity) & (q != v)
                q, v = q[ok], v[ok]
                n += np.bincount(q, weights=weight[v], minlength=len(ids)).astype(np.int64)
                forest.unite(q, v)
        some = np.flatnonzero((n > 0) | (forest.root != np.arange(len(ids))))
        return pa.table([pa.array(ids[some]), pa.array(n[some]), pa.array(ids[forest.root[some]])], names=["rep", "n", "root"])

    return run


def reachable(u: np.ndarray, centroids: np.ndarray, narrow: np.ndarray, wide: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Own region of each unit vector, and which regions may hold a vector within the range.

    `narrow` and `wide` are the least and the largest angle between a region's centroid and its own vectors.
    """
    s = u @ centroids.T
    own = np.argmax(s, axis=1)
    theta = math.acos(max(-1.0, min(1.0, similarity))) + 1e-6
    angle = np.arccos(np.clip(s, -1, 1))
    may = (angle <= wide + theta) & (angle >= narrow - theta)
    if theta < math.pi / 2:
        apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[own] @ centroids.T)))
        may &= s[np.arange(len(s)), own][:, None] - s <= math.sin(theta) * apart + 1e-6
    near = np.argpartition(-s, min(PROBES, len(centroids)) - 1, axis=1)[:, :PROBES]
    np.put_along_axis(may, near, True, axis=1)
    may[np.arange(len(s)), own] = True
    return own, may


def _regions(classes: DataFrame, similarity: float) -> DataFrame:
    """Class rows with region, part and slice, as vectors to be found (home), queries or both.

    A region's own vectors are dealt to parts, its queries to slices; each pair of a part and a slice is a task.
    """
    each = max(REGION, math.ceil(classes.count() / REGIONS))
    large = classes.groupBy("label", "d").agg(F.count("*").alias("n")).where(F.col("n") > each)
    per = {(r.label, r.d): r["n"] for r in large.collect()}  # at most REGIONS labels
    total = sum(per.values())
    centroids = {(label, d): np.zeros((1, d)) for label, d in per}
    if per:
        part = min(1.0, SAMPLE / total)
        picked = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(part * (1 << 20))).select("label", "d", "v").toPandas()
        for (label, d), rows in picked.groupby(["label", "d"]):
            if (label, d) in per:
                centroids[label, d] = kmeans(_unit(np.stack(rows.v.to_numpy()).astype(np.float64)), math.ceil(per[label, d] / each))
    shared = share(classes, centroids)

    def large_rows(b: pa.RecordBatch):
        """Label, size, places and unit vectors of rows with centroids, few at a time."""
        keys = {}
        for i, k in enumerate(zip(b.column("label").to_pylist(), b.column("d").to_pylist(), strict=True)):
            keys.setdefault(k, []).append(i)
        for k, rows in keys.items():
            if (c := shared.value.get(k)) is not None:
                step = max(1, TABLE // len(c))
                for s in range(0, len(rows), step):
                    some = np.array(rows[s : s + step])
                    yield k, some, _unit(_matrix(b.column("v").take(pa.array(some)), len(some)))

    def spread(batches):
        for b in batches:
            for (label, d), _, u in large_rows(b):
                s = u @ shared.value[label, d].T
                own = np.argmax(s, axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1))
                for r in np.unique(own).tolist():
                    a = angle[own == r]
                    yield pa.RecordBatch.from_pylist([{"label": label, "d": d, "region": r, "n": len(a), "narrow": float(a.min()), "wide": float(a.max())}], schema=spread_schema)

    spread_schema = pa.schema([("label", pa.int32()), ("d", pa.int32()), ("region", pa.int32()), ("n", pa.int64()), ("narrow", pa.float64()), ("wide", pa.float64())])
    count_schema = pa.schema([("label", pa.int32()), ("d", pa.int32()), ("region", pa.int32()), ("n", pa.int64())])
    bounds = {k: (np.full(len(c), math.inf), np.full(len(c), -math.inf), np.zeros(len(c), dtype=np.int64)) for k, c in centroids.items()}
    if per:
        measured = classes.mapInArrow(spread, "label int, d int, region int, n long, narrow double, wide double")
        for r in measured.groupBy("label", "d", "region").agg(F.sum("n").alias("n"), F.min("narrow").alias("narrow"), F.max("wide").alias("wide")).collect():
            narrow, wide, own = bounds[r.label, r.d]
            narrow[r.region], wide[r.region], own[r.region] = r.narrow, r.wide, r["n"]
    bound = share(classes, bounds)

    def queries(batches):
        for b in batches:
            n = {}
            for k, _, u in large_rows(b):
                narrow, wide, _ = bound.value[k]
                n[k] = n.get(k, 0) + reachable(u, shared.value[k], narrow, wide, similarity)[1].sum(axis=0)
            for (label, d), c in n.items():
                r = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), label), pa.int32()), pa.array(np.full(len(r), d), pa.int32()), pa.array(r, pa.int32()), pa.array(c[r], pa.int64())], schema=count_schema)

    tasks = {k: (np.maximum(1, -(-own // (2 * each))), np.ones(len(own), dtype=np.int64)) for k, (_, _, own) in bounds.items()}
    if per:
        asked = classes.mapInArrow(queries, "label int, d int, region int, n long")
        for r in asked.groupBy("label", "d", "region").agg(F.sum("n").alias("n")).collect():
            tasks[r.label, r.d][1][r.region] = max(1, -(-r["n"] // max(QUERIES, 2 * each)))
    dealt = share(classes, tasks)

    def run(batches):
        for b in batches:
            rep = mix(b.column("rep").to_numpy(zero_copy_only=False).astype(np.uint64)) >> np.uint64(1)
            rest = np.ones(b.num_rows, dtype=bool)
            for k, some, u in large_rows(b):
                rest[some] = False
                narrow, wide, _ = bound.value[k]
                parts, slices = dealt.value[k]
                own, may = reachable(u, shared.value[k], narrow, wide, similarity)
                turn = rep[some].astype(np.int64)
                i, r = np.nonzero(may)
                i, r, part = np.repeat(i, parts[r]), np.repeat(r, parts[r]), _within(parts[r])
                slice_ = (turn[i] // 1009) % slices[r]
                home = (r == own[i]) & (part == turn[i] % parts[r])
                j = np.repeat(np.arange(len(some)), slices[own])
                at = _within(slices[own])
                j, at = (w[at != (turn[j] // 1009) % slices[own[j]]] for w in (j, at))
                yield from rows_of(b, np.append(some[i], some[j]), np.append(r, own[j]), np.append(part, turn[j] % parts[own[j]]), np.append(slice_, at), np.append(home, np.ones(len(j), dtype=bool)), np.append(np.ones(len(i), dtype=bool), np.zeros(len(j), dtype=bool)))
            row = np.flatnonzero(rest)
            none, yes = np.zeros(len(row), dtype=np.int64), np.ones(len(row), dtype=bool)
            yield from rows_of(b, row, none, none, none, yes, yes)

    def rows_of(b, row, region, part, slice_, home, query):
        for s in range(0, len(row), 8192):
            e = slice(s, s + 8192)
            out = b.take(pa.array(row[e], pa.int64()))
            more = [pa.array(c[e], pa.int32()) for c in (region, part, slice_)] + [pa.array(c[e], pa.bool_()) for c in (home, query)]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, "region", "part", "slice", "home", "query"])

    kind = dict(classes.dtypes)["v"]
    return classes.mapInArrow(run, f"label int, d int, rep long, w long, v {kind}, region int, part int, slice int, home boolean, query boolean")


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each of the counts n, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def recalled(have: np.ndarray, true: np.ndarray) -> float:
    """The lesser of the share of links found and the mean share of a query with links; 0 if no query has links."""
    some = true > 0
    have, true = np.minimum(have, true)[some], true[some]
    return float(min(have.sum() / true.sum(), (have / true).mean())) if len(true) else 0.0


def _audit(classes: DataFrame, found: DataFrame, similarity: float) -> float:
    """Recall of bounded samples of classes, random ones and ones known to have links, against brute force over all classes."""
    n, linked = classes.count(), found.count()
    if not n:
        return 1.0
    all_ = 1 << 20
    dealt = lambda salt, of: F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(all_)) < int(all_ * min(1.0, AUDIT_ROWS / max(1, of)))
    known = F.col("n").isNotNull() & dealt(13, linked)
    sample = classes.join(found, "rep", "left").where(dealt(11, n) | known)
    rows = sample.select("label", "d", "rep", F.coalesce("n", F.lit(0)).alias("n"), "v").toPandas()
    queries = {}
    for (label, d), r in rows.groupby(["label", "d"]):
        queries[label, d] = (r.rep.to_numpy(), _unit(np.stack(r.v.to_numpy()).astype(np.float64)))
    shared = share(classes, queries)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            out = []
            for key, r in t.groupby(["label", "d"]):
                if key in shared.value:
                    ids, q = shared.value[key]
                    near = (q @ _unit(np.stack(r.v.to_numpy()).astype(np.float64)).T >= similarity) & (ids[:, None] != r.rep.to_numpy())
                    out += zip(ids.tolist(), (near @ r.w.to_numpy()).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([int(k) for _, k in out], pa.int64())], names=["rep", "true"])

    want = classes.mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true")).toPandas().set_index("rep").true
    return recalled(rows.set_index("rep").n.reindex(want.index).fillna(0).to_numpy(), want.to_numpy())


def near_duplicates(df: DataFrame, similarity: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: key, n_links, component_id, kept and audit_recall."""
    ensure_checkpoint_dir(df.sparkSession)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.col(vector)
    good = v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0)
    kind = "array<double>" if isinstance(df.schema[vector].dataType.elementType, DoubleType) else "array<float>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v.cast(kind)).alias("v"), F.col(label).cast("int").alias("label"))
    valid = rows.where("v IS NOT NULL AND id IS NOT NULL")
    classes = valid.groupBy("label", F.size("v").alias("d"), "v").agg(F.min("id").alias("rep"), F.count("*").alias("w")).select("label", "d", "rep", "w", "v").checkpoint()
    placed = _regions(classes, similarity).groupBy("label", "d", "region", "part", "slice")
    beam: int | None = BEAM
    while True:
        near = placed.applyInArrow(_region(similarity, beam), "rep long, n long, root long").checkpoint()
        found = near.groupBy("rep").agg(F.sum("n").alias("n"))
        recall = _audit(classes, found, similarity) if beam else 1.0  # a scan finds every link
        if recall >= WANTED:
            break
        beam = 2 * BEAM if beam == BEAM and recall else None
    comp = components(near.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(found, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, ["label", "v"], "left")
    reach = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0))
    return out.select(F.col("id").alias(key), n_links.cast("long").alias("n_links"), reach.alias("component_id"), F.coalesce(reach == F.col("id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))


def digest(embeddings: DataFrame) -> DataFrame:
    """Query op10."""
    return near_duplicates(embeddings).drop("audit_recall")
