"""Every table query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ephyspark.operators import signal as S
from ephyspark.plans import recording_queries, table_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


QUERIES = table_queries.queries() | recording_queries.queries()
SQL = table_queries.oracle_sql() | recording_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    assert len(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    for c in got.columns:
        if got[c].dtype != object and len(got):
            assert got[c].dtype == want[c].dtype, c


def test_offsets_of_rows_without_order_and_skewed_values(spark):
    rows = [(None, 5), (1, 1), (2, 2), (10**12, 3), (None, 7), (3, 4)]
    got = {(r.k, r.n): r.byte_offset for r in S.packet_offsets(spark.createDataFrame(rows, "k long, n long"), "k", F.col("n"), levels=3).collect()}
    assert len(got) == 6 and {got[None, 5], got[None, 7]} in ({0, 5}, {0, 7})
    assert [got[k] for k in ((1, 1), (2, 2), (3, 4), (10**12, 3))] == [12, 13, 15, 19]
    assert S.packet_offsets(spark.createDataFrame([], "k long, n long"), "k", F.col("n")).count() == 0


def plain_partitions(rows):
    by, out = {}, set()
    for c, t, k in rows:
        by.setdefault(c, []).append((t is not None, t or 0, k, t))
    for c, own in by.items():
        number, last = 1, None
        for _, _, k, t in sorted(own):
            number += last is not None and abs(t - last) > 2
            out.add((c, t, k, number))
            last = t
    return out


@pytest.mark.parametrize("hot_rows", [1, 100, 1 << 20])
def test_partitions_of_hot_channels(spark, hot_rows):
    """Split channels are numbered as whole ones: null and single-row channels, rows without a time, long pauses and ties."""
    rows, step = [(1, None, -1), (None, None, -2)], [1, 1, 1, 5, 0, 2, 3]
    for c, n in ((None, 900), (1, 3000), (2, 20), (3, 1)):
        t = 0
        for k in range(n):
            t += step[(k * k + (c or 0)) % 7] + 4000 * (k % 500 == 499)
            rows.append((c, t, k))
    df = spark.createDataFrame(rows, "ch int, t long, k int").repartition(5)
    t = F.col("t")
    got = S.partition_at_pauses(df, ["ch"], ["t", "k"], t, t, F.lit(2), hot_rows=hot_rows, whole_bytes=0)
    assert got.columns == ["ch", "t", "k", "partition"]
    assert {tuple(r) for r in got.collect()} == plain_partitions(rows)
    assert S.partition_at_pauses(df.limit(0), ["ch"], ["t", "k"], t, t, F.lit(2), hot_rows=hot_rows, whole_bytes=0).count() == 0


def test_partitions_by_times_and_texts(spark):
    rows = [(1, 0), (1, 1), (1, 9), (1, 10), (2, 5)]
    df = spark.createDataFrame(rows, "ch int, t long").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS time", "format_string('%02d', t) AS text")
    t = F.col("t")
    for order in ("t", "time", "text"):
        got = S.partition_at_pauses(df, ["ch"], [order], t, t, F.lit(2), hot_rows=1, whole_bytes=0)
        assert sorted((r.ch, r.t, r.partition) for r in got.collect()) == [(1, 0, 1), (1, 1, 1), (1, 9, 2), (1, 10, 2), (2, 5, 1)], order
