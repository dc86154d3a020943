"""Word and window hashes, and the operators on words that a linear hash can't tell apart."""

import math
import zlib

import numpy as np
import pytest

from ephyspark.llm import core, decontam, minhash, ppm, substring

from . import brute


def thue_morse(doublings):
    """Two complementary words of 2 ** doublings letters, equal under every polynomial modulo a power of two from 1,024 on."""
    swap = str.maketrans("ab", "ba")
    x = "a"
    for _ in range(doublings):
        x += x.translate(swap)
    return x, x.translate(swap)


X, Y = thue_morse(10)


@pytest.mark.parametrize("doublings", [3, 5, 8, 10, 13])
def test_words_apart(doublings):
    x, y = thue_morse(doublings)
    data = np.frombuffer(f"{x} {y} {x}".encode(), dtype=np.uint8)
    starts, ends, _ = core.words(data, np.array([0, len(data)]), core.non_space_table())
    h = core.word_hashes(data, starts, ends)
    assert h[0] == h[2] != h[1]


def test_windows():
    h = np.tile(np.arange(30, dtype=np.uint64), 2)
    for width in range(1, 26):
        g = core.window_hashes(h, width)
        assert len(g) == len(h) - width + 1
        assert (g[30:] == g[: len(g) - 30]).all() and len(set(g.tolist())) == 30
    assert not len(core.window_hashes(h, 61))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats(spark):
    rows = [(1, " ".join([X] * 3 + ["w"] * 17)), (2, " ".join([Y] * 3 + ["w"] * 17)), (3, " ".join([X] * 3 + ["w"] * 17))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(frame(spark, rows)).collect()}
    assert got == brute.repeats(rows) and got[2][1] == 0 and got[3][1] == 20


def test_near_duplicates(spark):
    rows = [(1, X), (2, Y), (3, X)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.digest(frame(spark, rows)).collect()}
    assert got == brute.near(rows) == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False)}


def test_decontamination(spark):
    rows, items = [(1, f"{X} b c"), (2, f"{Y} b c")], [(7, X)]
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.leaks(rows, items) and got[1][4] and not got[2][4]


def test_base_scores(spark):
    rows = [(i, t) for i, t in zip([k for k in range(40) if zlib.crc32(str(k).encode()) % 5 != 1], [f"{X} {X} {Y}", "q"], strict=False)]
    got = {r.doc_id: r for r in ppm.digest(frame(spark, rows)).collect()}
    n, v = 6, 4  # the words and two ends; X, Y, q and the end
    want = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (2, 2, 1, 2))
    assert got[rows[0][0]].train_tokens == n and got[rows[0][0]].base_score == pytest.approx(want, rel=1e-12)
