"""Operators 1, 3 and 4 against brute force, on the small tables and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from ephyspark.llm import decontam, langid, minhash, ppm, queries, substring

from . import brute

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def awkward(seed=3):
    r = random.Random(seed)
    vocab = ["a", "B", "b", "cc", "é", "ÉÉ", "x1", "-", "the", "\x1c", "\x85", "z."]
    base = [r.choice(vocab) + str(r.randrange(40)) for _ in range(400)]
    rows = [(i, None) for i in (5,)] + [(6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE two"), (10, "a " * 300), (11, "a " * 300 + "b"), (12, "a " * 25)]
    for i in range(20, 120):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "n" + str(r.randrange(10**6))
        cut = r.randrange(0, 40)
        rows.append((i, r.choice([" ", "\n", "  "]).join(w[cut:])))
    rows += [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 200)))) for i in range(200, 260)]
    rows += [(i, rows[20][1]) for i in range(300, 310)]
    return rows


@pytest.mark.parametrize("rows", ["table", "awkward"])
def test_repeats(spark, rows):
    rows = documents(spark) if rows == "table" else awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.repeats(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df).collect()}
    assert got == want


@pytest.mark.parametrize("rows", ["table", "awkward"])
def test_near_duplicates(spark, rows):
    rows = documents(spark) if rows == "table" else awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.digest(df).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for docs, own in ((documents(spark), items), (awkward(), [(1, "a25 b"), (2, None), (3, ""), (3, "one TWO"), (4, "a " * 30), (11, awkward()[20][1][:300])])):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        bench = spark.createDataFrame(own, "item_id long, text string")
        got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(df, bench).collect()}
        assert got == brute.leaks(docs, own)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.digest(none).count() == 0
    assert minhash.digest(none).count() == 0
    assert decontam.digest(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y", 3, "g", None, 5, 0.5)], "doc_id long, text string, n_words long, g string, hit_spans string, kept int, score double")
    r = substring.remove_repeats(df).first()
    assert (r.n_words, r.g, r.kept, r.hit_spans, r.score) == (2, "g", "x y", None, 0.5)
    r = decontam.mark(df, df.select("doc_id", "text"), item_id="doc_id").first()
    assert (r.n_words, r.g, r["items"], r.kept) == (2, "g", ["1"], 5)
    r = ppm.score(df, F.lit(True)).first()
    assert (r.n_tokens, r.g, r.kept) == (3, "g", 5) and r.score < 0
    r = langid.predict(df, langid.fit(df, lang="g")).first()
    assert (r.lang_pred, r.g, r.n_words) == ("g", "g", 3)
    assert minhash.near_duplicates(df.selectExpr("cast(doc_id AS int) AS doc_id", "text")).count() == 1
    assert queries.queries()


def variants(n, words=60, changed=2, seed=5):
    """Texts that differ from one another in a few words; most pairs match often, few are linked."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(words), changed):
            w[k] = f"n{r.randrange(30)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("limits", [{}, {"LIST": 64, "SHORT": 4, "BLOCK": 4000}, {"LIST": 40, "BLOCK": 900, "PASS": 1 << 12}])
def test_large_groups(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    rows = variants(300) + [(1000 + i, t) for i, t in variants(200, changed=1)] + [(2000, " ".join(f"w{k}" for k in range(60)))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.near(rows)


def test_group_texts_move_once(spark, monkeypatch):
    """5,000 variants of one text: the rows that carry texts to the exact comparison stay below twice the members."""
    moved = spark.sparkContext.accumulator(0)
    solve = minhash._whole_groups

    def counted(length, percent):
        inner = solve(length, percent)

        def run(batches):
            def seen():
                for b in batches:
                    moved.add(b.num_rows)
                    yield b

            return inner(seen())

        return run

    monkeypatch.setattr(minhash, "_whole_groups", counted)
    rows = variants(5000)
    got = minhash.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == 5000 and 0 < moved.value < 2 * 5000


def test_rows_without_key_and_repeated_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (None, t), (1, t), (2, t), (2, t)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.digest(df).where("doc_id IS NOT NULL").collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in minhash.digest(df).where("doc_id IS NULL").collect()] == [(3, None, True)] * 2


def test_hot_minimizer_and_rows_without_key(spark, monkeypatch):
    """One common run of words in most documents, split by window; null keys come first and are spread."""
    monkeypatch.setattr(substring, "HOT", 2)
    r = random.Random(8)
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(i, " ".join(f"v{r.randrange(50)}" for _ in range(r.randrange(25))) + f" {common} " + " ".join(f"v{r.randrange(50)}" for _ in range(25))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df).collect()} == brute.repeats(rows)
    mixed = spark.createDataFrame([(None, rows[0][1])] * 2 + [(None, rows[1][1]), (5, rows[0][1])], "doc_id long, text string")
    got = substring.digest(mixed).collect()
    assert sum(r.n_removed == 0 for r in got) == 1 and [r.n_removed for r in got if r.doc_id == 5] == [len(rows[0][1].split())]
