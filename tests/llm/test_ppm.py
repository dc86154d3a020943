"""Operator 8 against a plain model: a dictionary trie walked symbol by symbol."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ephyspark.llm import ppm

from . import brute
from .test_text_ops import awkward, documents


def symbols(text):
    return (" ".join(brute.SPACE.findall(brute.lower(text or ""))) + "\n").encode()


def plain_scores(rows):
    tries = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    words, trains = Counter(), {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    for i, text in rows:
        if trains[i]:
            words.update([*brute.SPACE.findall(brute.lower(text or "")), None])
            s = b"\n" * ppm.ORDER + symbols(text)
            for k in range(ppm.ORDER, len(s)):
                for o in range(ppm.ORDER + 1):
                    tries[o][s[k - o : k]][s[k]] += 1
    total, types = sum(words.values()), len(words)

    def chance(context, symbol):
        out, gone = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            node = {s: c for s, c in tries[o].get(context[ppm.ORDER - o :], {}).items() if s not in gone}
            left = sum(node.values())
            if left and symbol in node:
                return out + math.log10((node[symbol] - ppm.ESCAPE) / left)
            if left:
                out += math.log10(ppm.ESCAPE * len(node) / left)
            gone |= set(tries[o].get(context[ppm.ORDER - o :], {}))
        return out - math.log10(256 - len(gone))

    out = {}
    for i, text in rows:
        s = b"\n" * ppm.ORDER + symbols(text)
        score = sum(chance(s[k - ppm.ORDER : k], s[k]) for k in range(ppm.ORDER, len(s)))
        w = [*brute.SPACE.findall(brute.lower(text or "")), None]
        base = sum(math.log10((words[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        out[i] = (not trains[i], len(w), sum(words[x] > 0 for x in w), total, base, score)
    return out


@pytest.mark.parametrize(("rows", "hot"), [("table", ppm.HOT_ONE_IN), ("awkward", ppm.HOT_ONE_IN), ("awkward", 1 << 40), ("awkward", 1)])
def test_scores(spark, monkeypatch, rows, hot):
    """Few, all and no contexts are split by their third byte."""
    monkeypatch.setattr(ppm, "HOT_ONE_IN", hot)
    rows = documents(spark)[:60] if rows == "table" else awkward()
    want = plain_scores(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in ppm.digest(df).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], rel=1e-9)
        assert got[i][5] == pytest.approx(w[5], rel=1e-5)


def test_rows_in_another_order_at_each_reading(spark):
    """A group's rows come in any order when they are read again, as from several executors."""
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    rows = awkward()
    want = plain_scores(rows)

    def shuffled(batches):
        r = np.random.default_rng()
        for b in batches:
            yield b.take(r.permutation(b.num_rows))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: tuple(r)[1:] for r in ppm.digest(df.mapInArrow(shuffled, df.schema)).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], rel=1e-9)
        assert got[i][5] == pytest.approx(w[5], rel=1e-5)


def test_no_training_rows(spark):
    rows = [(i, "ab") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = ppm.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(-3 * math.log10(256), rel=1e-6) and r.train_tokens == 0 for r in got)
    assert ppm.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_rows_without_key(spark):
    rows = [(None, "x y"), (None, "x y"), (4, "x y"), (4, "x y"), (None, None)]
    got = ppm.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {13}
    assert len({r.score for r in got if r.n_tokens == 3}) == 1 and [r.n_tokens for r in got].count(1) == 1


def test_triples():
    r = np.random.default_rng(3)
    for top in (30, 256):
        runs = r.integers(0, top, 5000, dtype=np.uint64) | r.integers(0, top, 5000, dtype=np.uint64) << np.uint64(8) | r.integers(0, top, 5000, dtype=np.uint64) << np.uint64(16)
        key, n = ppm._triples(runs | np.uint64(1 << 40))
        assert dict(zip(key.tolist(), n.tolist(), strict=True)) == Counter(runs.tolist())
