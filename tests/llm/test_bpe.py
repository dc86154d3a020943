"""Operator 5 against the tokenizers library."""

import hashlib
import random

import pytest

from ephyspark.llm import bpe
from ephyspark.llm.queries import bpe_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe_path())


@pytest.fixture(scope="module")
def codec():
    with open(bpe_path(), encoding="utf-8") as f:
        return bpe.Codec(bpe.Vocabulary(f.read()))


def odd_texts(n=3000, seed=1):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "1", "²", "\x1c", "\x85", "\xa0", "　", "😀", "​", "'s", "'S", "<|endoftext|>", "!", "_", "漢", "\r\n", "Ⅷ", "á", "\U0001e900", "\U00013cb6", "\U0003f3da"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(n)]
    texts += ["".join(chr(r.choice([r.randrange(0x250), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(12)) for _ in range(n)]
    return [*texts, "", "a" * 5000, "ab" * 3000 + " " * 500 + "x", "é" * 3000]


def test_same_ids(codec, library):
    texts = odd_texts()
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == e.ids, repr(text)
        assert codec.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_cuts_are_certain(codec):
    inside = codec.v.inside
    assert 0 < len(inside) < 1 << 16
    assert all(b[k : k + 2] in inside for b in codec.v.token.values() for k in range(len(b) - 1))


def test_digest(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(100))] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(df, bpe_path()).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    ids = bpe.encode(df, bpe_path())
    assert bpe.decode(ids, bpe_path()).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.digest(df.limit(0), bpe_path()).count() == 0
    assert bpe.encode(ids, bpe_path()).columns == ids.columns
