"""Operator 9: accuracy on held-out documents, the filter's promises, and awkward rows."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ephyspark.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_filters_hold_all_and_little_else():
    r = np.random.default_rng(3)
    grams = [r.integers(0, 2**40, n, dtype=np.uint64) for n in (5000, 8000, 1)]
    m = langid.build(["a", "b", "c"], grams)
    at = lambda g: np.bitwise_and.reduce([m.table[s] for s in langid._slots(g, len(m.table))])
    for l, g in enumerate(grams):
        assert ((at(g) >> l) & 1).all()
    other = at(r.integers(2**41, 2**42, 20_000, dtype=np.uint64))
    for l in range(3):
        assert abs(((other >> l) & 1).mean() - m.false_rate[l]) < 0.02


def test_ngrams_of_each_text():
    for order, (keys, good, first) in zip(langid.ORDERS, langid.ngrams(pa.array(["Ab c", None, "d1é"])), strict=True):
        cuts = np.append(first, len(keys))
        texts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            texts.append([(int(k) & (1 << 8 * order) - 1).to_bytes(order, "little") for k in keys[a:b][good[a:b]]])
        want = [s.encode() for s in (" ab c ", "", " d é ")]
        assert texts[0] == [want[0][i : i + order] for i in range(len(want[0]) - order + 1)]
        assert texts[1] == []
        assert texts[2] == [want[2][i : i + order] for i in range(len(want[2]) - order + 1)]


def test_awkward_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "der hund und die katze", "de") for i in range(15)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (503, "q", None), (504, "der hund " * 3000, None), (None, "und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.digest(df).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] in ("en", "de") and got[504][0] == "de" and got[0][0] == "en" and got[None][0] == "de"
    none = df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")
    assert {r.lang_pred for r in langid.digest(none).collect()} == {"und"}
    assert langid.digest(df.limit(0)).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    """150 languages of their own letters each; the rarest are learned as well as the first."""
    r = np.random.default_rng(4)
    alphabets = [[chr(0x4E00 + 40 * l + k) for k in range(40)] for l in range(150)]
    text = lambda l: "".join(alphabets[l][k] for k in r.integers(0, 8, 60))
    rows = [(100_000 * l + i, text(l), f"l{l:03d}") for l in range(150) for i in range(12 if l < 75 else 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 150 and model.table.shape[1] == 3
    new = spark.createDataFrame([(l, text(l)) for l in range(150)], "l int, text string")
    got = langid.predict(new, model).collect()
    assert all(r.lang_pred == f"l{r.l:03d}" and r.score > langid.REJECT_BELOW for r in got)


def plain_grams(text, order):
    """N-grams of a text, one by one: letters are lower-cased ASCII and bytes from 0x80, all else is a space."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    raw = b" " + raw + b" "
    return [raw[i : i + order] for i in range(len(raw) - order + 1) if b"  " not in raw[i : i + order]]


def test_against_plain_sets(spark, monkeypatch):
    """The whole path with plain sets in place of the filters: same n-grams learned, same shares up to the false positives."""
    monkeypatch.setattr(langid, "TOP", 700)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None]
    counts = {l: Counter(g for r in learn if r.lang == l for k in langid.ORDERS for g in plain_grams(r.text, k)) for l in {r.lang for r in learn}}
    share = {l: {g: n / sum(c.values()) for g, n in c.items()} for l, c in counts.items()}
    best = Counter()
    for p in share.values():
        for g, v in p.items():
            best[g] = max(best[g], v)
    sets = {}
    for l, c in counts.items():
        use = sorted((n for g, n in c.items() if n > 1 and share[l][g] >= langid.SHARE * best[g]), reverse=True)
        least = use[langid.TOP] if len(use) > langid.TOP else 1  # all above it are held, of those as frequent a part
        sets[l] = ({g for g, n in c.items() if n > least and share[l][g] >= langid.SHARE * best[g]}, {g for g, n in c.items() if n >= max(2, least) and share[l][g] >= langid.SHARE * best[g]})
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 0)))
    assert set(model.languages) == set(sets)
    key = lambda g: np.array([int.from_bytes(g, "little") | len(g) << 40], dtype=np.uint64)
    for number, l in enumerate(model.languages):
        for g in sets[l][0]:
            assert all(int(model.table[s, number // 64][0]) >> number % 64 & 1 for s in langid._slots(key(g), len(model.table)))
    got = {r.doc_id: r for r in langid.digest(docs).collect()}
    for r in rows:
        grams = [g for k in langid.ORDERS for g in plain_grams(r.text, k)]
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        low = {l: sum(g in a for g in grams) / len(grams) for l, (a, _) in sets.items()}
        high = {l: sum(g in b for g in grams) / len(grams) for l, (_, b) in sets.items()}
        noise = 0.05 + 2 / len(grams) ** 0.5 * 0.1
        assert low[got[r.doc_id].lang_pred] - noise <= got[r.doc_id].score <= high[got[r.doc_id].lang_pred] + noise
        sure = [l for l in sets if all(low[l] > high[o] + 2 * noise for o in sets if o != l)]
        assert not sure or got[r.doc_id].lang_pred == sure[0]


def test_cuts():
    """Whole groups of equal frequency and tie, TOP at most; nothing where the first group is larger."""
    h = pd.DataFrame({"l": [0, 0, 0, 1], "n": [9, 5, 5, 4], "tie": [3, 1, 2, 0], "m": [langid.TOP - 10, 10, 1, langid.TOP + 1]})
    c = langid.cuts(h)
    assert [n * langid.TIES - t >= c[l] for l, n, t in zip(h.l, h.n, h.tie, strict=True)] == [True, True, False, False]


def test_repeated_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] * 2 + [(50, "der hund und die katze", "de")] * 3
    got = langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 43 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 21
