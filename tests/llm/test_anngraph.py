"""Operator 10 against all pairs in double precision."""

import math

import numpy as np
import pytest

from ephyspark.llm import anngraph


def plain(rows, least=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float32).astype(np.float64)
    root, links = {}, {k: 0 for k in range(len(rows))}
    for k, (i, _, _) in enumerate(rows):
        root.setdefault(i, i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = list(good)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = good[a], good[b]
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                root[q] = p
    return {rows[k][0]: (links[k], find(rows[k][0]), find(rows[k][0]) == rows[k][0]) for k in range(len(rows))}


def made(seed=1):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = r.standard_normal(16)
            for _ in range(r.integers(1, 6)):
                rows.append((i, (base + 0.15 * r.standard_normal(16)).astype(np.float32).tolist(), label))
                i += 1
    copies = [(1000 + k, rows[0][1], 0) for k in range(40)]
    odd = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [None] + [1.0] * 15, 0), (2006, [1.0, 2.0], 0), (2007, [float("inf")] + [1.0] * 15, 0)]
    return rows + copies + odd


@pytest.mark.parametrize("region", [3000, 40])
def test_links(spark, monkeypatch, region):
    monkeypatch.setattr(anngraph, "REGION", region)
    monkeypatch.setattr(anngraph, "SHARD", 30)
    monkeypatch.setattr(anngraph, "PROBES", 3 if region > 100 else 8)
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in anngraph.digest(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    found, true = sum(min(got[i][0], want[i][0]) for i in want), sum(w[0] for w in want.values())
    assert found >= 0.98 * true and all(got[i][0] <= want[i][0] for i in want)
    if region > 100:
        assert got == want
        wide = df.selectExpr("cast(vec_id AS int) AS vec_id", "cast(embedding AS array<double>) AS embedding", "label")
        assert {r.vec_id: r.component_id for r in anngraph.digest(wide).collect()} == {i: w[1] for i, w in want.items()}


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in anngraph.digest(df).collect()}
    assert got == plain(rows)
    assert anngraph.digest(df.limit(0)).count() == 0


def hot(n=3000, seed=5):
    """One label; a third of the rows is one group of distinct near copies, the others are rare pairs."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = unit(r.standard_normal((1, 64)) + 0.22 * r.standard_normal((n // 3, 64)))
    base = unit(r.standard_normal((n // 3, 64)))
    x = np.concatenate([group, base, unit(base + 0.02 * r.standard_normal(base.shape))]).astype(np.float32)
    return x[r.permutation(len(x))]


def true_links(x, least=0.93):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= least
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("tasks", [1, 4])
def test_hot_group_over_many_regions(spark, monkeypatch, tasks):
    monkeypatch.setattr(anngraph, "REGION", 30)
    if tasks > 1:  # regions of several slices, and k-means on so few rows that regions have several parts
        monkeypatch.setattr(anngraph, "QUERIES", 300)
        monkeypatch.setattr(anngraph, "SAMPLE", 60)
    x = hot()
    want = true_links(x)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in anngraph.digest(df).collect()}
    have, true = np.array([got[i] for i in range(len(x))]), want.sum(axis=1)
    assert true.max() > 900 and (have <= true).all()
    some = true > 0
    assert have.sum() >= 0.98 * true.sum() and (have[some] / true[some]).mean() >= 0.98


def test_bounds_lose_no_pair():
    x = hot(1500).astype(np.float64)
    c = anngraph.kmeans(x, 25)
    own = np.argmax(x @ c.T, axis=1)
    angle = np.arccos(np.clip((x * c[own]).sum(axis=1), -1, 1))
    narrow, wide = (np.array([f(angle[own == r], initial=start) for r in range(25)]) for f, start in ((np.min, np.inf), (np.max, -np.inf)))
    home, may = anngraph.reachable(x, c, narrow, wide, 0.93)
    a, b = np.nonzero(true_links(x))
    assert (home == own).all() and may[a, own[b]].all() and not may.all()


def test_gives_up_on_no_graph(spark, monkeypatch):
    """A graph that finds nothing is replaced by a scan, whatever the audit's sample holds."""
    monkeypatch.setattr(anngraph, "REGION", 40)
    monkeypatch.setattr(anngraph, "_region", _with_broken_graph(anngraph._region))
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in anngraph.digest(df).collect()} == plain(rows)


def _with_broken_graph(region):
    def made_(similarity, beam):
        run = region(similarity, beam)

        def broken(t):
            out = run(t)
            return out.slice(0, 0) if beam else out

        return broken

    return made_


def test_audit_counts_queries_and_links():
    assert anngraph.recalled(np.array([1000, 0]), np.array([1000, 1])) == 0.5
    assert anngraph.recalled(np.array([500, 1, 1]), np.array([1000, 1, 1])) < 0.51
    assert anngraph.recalled(np.array([0, 0]), np.array([0, 0])) == 0.0


def test_repeated_ids_and_rows_without_id(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [1.0, 0.01], 3), (None, [1.0, 0.0], 3), (None, None, 3), (5, [0.0, 1.0], 3), (5, [1.0, 0.0], None)]
    got = sorted((tuple(r) for r in anngraph.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 2 + [(2, 2, 1, False)] + [(None, 0, None, True)] * 2 + [(5, 0, 5, True)] * 2, key=str)
