"""Operator 7 on the page table, whose articles can be cut out plainly, and on synthetic layouts that it wasn't trained on."""

import html
import random
import re
import time

import numpy as np
import pytest

from ephyspark.llm import htmltext


def plain_article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in htmltext.digest(rows).collect()}
    for r in rows.collect():
        assert got[r.page_id].text == plain_article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_other_layouts():
    model, r = htmltext.model(), random.Random(991)
    same = words = kept = true = 0
    for _ in range(150):
        page = htmltext.Page(htmltext.synthetic_page(r))
        want = htmltext.labelled(page).astype(bool)
        got = htmltext.decode(page, model.log_odds(htmltext.features(page)))
        a, b = htmltext.render(page, want).split(), htmltext.render(page, got).split()
        same += a == b
        words += len(set(a) & set(b))
        kept, true = kept + len(set(b)), true + len(set(a))
    assert words / true > 0.97 and words / kept > 0.97 and same > 100


def test_held_out_recall():
    """The figure that the README states."""
    model, r = htmltext.model(), random.Random(4711)
    words = true = 0
    for _ in range(1500):
        page = htmltext.Page(htmltext.synthetic_page(r))
        want = set(htmltext.render(page, htmltext.labelled(page).astype(bool)).split())
        got = set(htmltext.render(page, htmltext.decode(page, model.log_odds(htmltext.features(page)))).split())
        words, true = words + len(want & got), true + len(want)
    assert words / true > 0.997


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<<<>>> &amp; <", None),
        ("<article><h1>A &amp; B</h1><p>one\n  two<p>three&nbsp;four <b>five</b>six</article>", "A & B\none two\nthree four fivesix"),
        ("<nav><a href=x>home</a></nav><article><p>" + "long text " * 30 + "</p><!-- <p>no</p> --><script>var a='<p>x</p>'</script></article><footer>c</footer>", ("long text " * 30).strip()),
    ],
)
def test_pages(spark, source, text):
    got = htmltext.digest(spark.createDataFrame([(1, "u", source), (2, "u", None)], "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert by[2] == "" and (text is None or by[1] == text)


@pytest.mark.parametrize(
    "piece",
    ["<a", "</b>", "<!", "<a \">", "<a \"'>", "<a \">\" ", "<a '", "<li>", "<p>a", "<b> </b>", "<div>", "<script>", "<!--", "< ", "<td><b>", "class = "],
)
def test_broken_pages_take_linear_time(piece):
    source = "<p><div><b>" + piece * (1_000_000 // len(piece)) + "<hr>"
    began = time.process_time()
    page = htmltext.Page(source)
    assert time.process_time() - began < 2
    htmltext.render(page, np.ones(len(page.kind), dtype=bool))
    assert time.process_time() - began < 4


def test_quotes():
    """A tag ends outside quotes; where they don't close, at the first mark."""
    texts = lambda s: [t for t in htmltext.Page(s).text if t]
    assert texts("<a title='x>y'>in</a>") == ["in"]
    assert texts("<a title='x>y</a>") == ["y"]
    assert texts('<a ">" <a ">" <b>t') == ["t"]
    assert texts('<a ">" <b') == ['" <b']
    assert texts("a < b <c") == ["a < b <c"]


def test_empty_repeated_and_clashing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.digest(none).collect() == []
    html_ = "<article><h1>T</h1><p>" + "some words here " * 20 + "</p></article><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", html_, "old", 7)] * 3, "page_id long, url string, html string, main_text string, kind int")
    got = htmltext.extract(df).collect()
    assert len({tuple(r) for r in got}) == 1 and len(got) == 3 and got[0].kind == 7 and got[0].main_text.startswith("T\nsome words")
