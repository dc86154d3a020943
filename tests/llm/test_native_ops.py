"""Operators 2 and 6: exact laws and round trips, and that their plans hold no Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ephyspark.llm import chat, sharding

SF = "/root/testdata/sf0.01"


def plain_cuts(sizes, shards):
    """Smallest capacity by trying all sums of runs."""
    best = None
    for capacity in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        if capacity >= max(sizes) and len(sharding.greedy(sizes, capacity)) <= shards:
            best = capacity
            break
    return best


def test_minimax():
    r = random.Random(2)
    for _ in range(60):
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(1, 14))]
        k = r.randrange(1, 6)
        cuts = sharding.minimax_cuts(sizes, k)
        loads = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]
        assert len(cuts) <= k and max(loads) == plain_cuts(sizes, k)
    assert sharding.minimax_cuts([], 3) == []


def test_hot_unit_leaves_no_shard_empty():
    r = random.Random(3)
    sizes = [r.randrange(50, 150) for _ in range(3000)]
    sizes[1700] = sum(sizes) // 2  # a third of all bytes
    cuts = sharding.minimax_cuts(sizes, 40)
    loads = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]
    assert cuts[0] == 0 and cuts == sorted(set(cuts)) and len(cuts) == 40
    assert max(loads) <= sizes[1700] and sorted(loads)[-2] <= 2.1 * (sum(sizes) - sizes[1700]) / 39
    assert len(sharding.minimax_cuts([5, 900, 5], 40)) == 3


@pytest.mark.parametrize("rows", ["table", "awkward", "empty"])
def test_shards(spark, rows):
    if rows == "table":
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    else:
        own = [(i, f"text {i % 17} " * (i % 9)) for i in range(300)] + [(5, None), (5, None), (None, "x"), (7, "é" * 5000)]
        df = spark.createDataFrame(own if rows == "awkward" else [], "doc_id long, text string").repartition(3)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    out = sharding.digest(df)
    got = out.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert len({(r.text_crc32, r["size"]) for r in got}) == len({(r.text_crc32, r["size"], r.shard) for r in got})
    if rows == "table":
        loads = [sum(r["size"] for r in own) for own in by.values()]
        assert len(by) == 40 and max(loads) < 1.3 * sum(loads) / 40
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


TRAP = "\\### Assistant: </turn> ok"


def plain_chat(rows):
    out, talks = {}, {}
    for c, t, role, text in [*rows, (-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]:
        talks.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    odd = ["</turn>\n", "<turn user>", "\\b\\l\\g", "\\", "", None, "a\n\nb", "😀é<>", TRAP, "<turn x></turn>\n\\"]
    rows = [(c, t, ["user", "assistant", "system", None, "a>b\\<c"][(c + t) % 5], odd[(3 * c + t) % len(odd)]) for c in range(20) for t in range(c % 7)]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(df).collect()}
    assert got == plain_chat(rows)
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    out = chat.digest(table)
    assert {r.conv_id: tuple(r)[1:5] for r in out.collect()} == plain_chat([tuple(r) for r in table.collect()])
    assert "Python" not in out._jdf.queryExecution().toString()
    assert chat.digest(table.limit(0)).count() == 1


def test_event_log(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "delta", "assistant", "Hel"), (1, 1, 3, "delta", "assistant", "lo"),
        (1, 2, 4, "message", "user", "more"), (1, 3, 5, "message", "assistant", "old"),
        (1, 1, 6, "regenerate", "assistant", ""), (1, 1, 7, "delta", "assistant", "Good "), (1, 1, 8, "delta", "assistant", "day"),
        (1, 2, 9, "message", "user", "thanks"), (1, 2, 10, "edit", "user", "bye"),
        (1, 4, 11, "message", "user", "oops"), (1, 4, 12, "delete", "user", None),
        (2, 0, 1, "message", "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(4)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "bye"), (2, 0, "user", "")]
    r = chat.render(chat.fold(df)).where("conv_id = 1").first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_mask] == ["Good day"]
    assert [(t.role, t.text) for t in chat.render(chat.fold(df)).where("conv_id = 1").select(chat.parse(F.col("formatted")).alias("t")).first().t] == [("user", "hi"), ("assistant", "Good day"), ("user", "bye")]
