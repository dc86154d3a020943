"""The pipeline stage by stage against brute force, on the smallest tables."""

import pytest

import corpus_pipeline
from ephyspark.llm.queries import bpe_path, oracle_sql, queries

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{k}-{name}")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r.doc_id: r for r in d.collect()} for d in out], [d.columns for d in out]


def test_columns(steps):
    assert all(c == steps[1][0] for c in steps[1][:-1])


def test_language_keeps_clean_documents(steps):
    before, after = steps[0][0], steps[0][1]
    assert after == {i: r for i, r in before.items() if i in after}
    gone = [r for i, r in before.items() if i not in after]
    assert all(not any(c.isalpha() for c in r.text) for r in gone)


def test_near_duplicates(steps):
    before, after = steps[0][1], steps[0][2]
    want = brute.near([(i, r.text) for i, r in before.items()], 80)
    assert after == {i: r for i, r in before.items() if want[i][2]}


def test_repeated_passages(steps):
    before, after = steps[0][2], steps[0][3]
    want = brute.repeats([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        if want[i][1]:
            assert brute.sha(r.text) == want[i][2]
        else:
            assert r.text == before[i].text


def test_benchmark_leaks(spark, steps):
    before, after = steps[0][3], steps[0][4]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.leaks([(i, r.text) for i, r in before.items()], items)
    assert after == {i: r for i, r in before.items() if not want[i][4]}


def test_tokens(steps):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe_path())
    before, after = steps[0][4], steps[0][5]
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.ids == t.encode(before[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip


def test_run_and_registry(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[0][-1])
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(oracle_sql()) <= set(names)


def test_awkward_rows(spark):
    rows = [(1, None, "en", "s", 0), (None, "a b c d e f", None, None, None), (2, "", "en", "s", 0), (3, "x y z w v u", "en", "s", 11), (3, "x y z w v u", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 AS g", "2 AS n_words", "'x' AS kept", "0.5D AS score", "3 AS lang_pred", "4 AS hit_spans", "5 AS `a.b`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and {(r.g, r.n_words, r.kept) for r in out.collect()} <= {(1, 2, "x")}, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        stage(spark, docs.limit(0), SF).collect()
    name, encode = corpus_pipeline.STAGES[4]
    want = encode(spark, docs, SF).columns
    assert encode(spark, clash, SF).columns == want and encode(spark, docs.limit(0), SF).collect() == []
    got = encode(spark, clash, SF).collect()
    assert len(got) == 5 and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0] and len({str(r) for r in got if r.doc_id == 3}) == 1


def test_near_duplicates_by_text_not_id(spark):
    """A repeated doc_id with other texts loses none; copies without an id are one, and yield to one with an id."""
    text = lambda w, n=40: " ".join(f"{w}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a") + " more"), (None, text("c")), (None, text("c")), (None, text("d")), (9, text("d")), (None, text("e")), (None, text("f")), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (9, text("d")), (None, text("e")), (None, text("f")), (7, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
