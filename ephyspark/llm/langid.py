"""Language identification by bit-sliced Bloom filters of n-grams (operator 9).

One table of bit masks serves as a Bloom filter for every language at once: a slot's bit l belongs to language l; beyond 64
languages, a slot has as many words of 64 bits as they need. The masks at an n-gram's three slots, ANDed, are all the languages that contain it. Per language the n-grams of a text that
have its bit are counted, the count is corrected for the false positives that the language's share of set bits implies,
and the largest corrected share decides.

N-grams are of three and four bytes over lower-cased text in which all that isn't a letter is a space; n-grams with two
spaces in a row are left out. A filter is fitted on at most about SAMPLE_ROWS labelled rows of each language, chosen by
a hash of the key, and holds its most frequent n-grams that are not far more usual in another language, TOP at most; of those
as frequent as the last ones it holds whole 256ths by hash.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if no row is
labelled; a text without any known n-gram gets the language with the most labelled rows and score 0; ties go to the
language with more labelled rows, then by name; repeated rows are judged alike; a very long text is one pass of its own and
as large as a row may be; an empty table gives an empty table; other columns pass through, and a column with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .core import ensure_checkpoint_dir, lower_table, mix, passes, share, text_bytes

#: Labelled rows of a language that the fit uses (about), and n-grams that its filter holds.
SAMPLE_ROWS, TOP = 2000, 60_000
#: An n-gram must be at least this share as frequent in a language as in the one where it is most frequent.
SHARE = 0.2
#: Shares below this reject a document in a filtering stage.
REJECT_BELOW = 0.3
ORDERS, SLOTS = (3, 4), 3
#: Parts of n-grams that are equally frequent.
TIES = 256
#: An n-gram's key is below 2 ** GRAM_BITS; a language's number stands above it.
GRAM_BITS = 44


def _letters() -> np.ndarray:
    t = lower_table()
    other = np.ones(256, dtype=bool)
    other[97:123] = other[65:91] = other[128:] = False
    t[other] = 32
    return t


_LETTERS = _letters()


def ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: keys of the n-grams at all places, which of them count, and each text's first place."""
    data, off = text_bytes(column)
    size = np.diff(off)
    framed = np.full(len(data) + 2 * len(size) + 4, 32, dtype=np.uint8)
    framed[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(size)), size)] = _LETTERS[data]
    first = off[:-1] + 2 * np.arange(len(size))
    n = len(framed) - 4
    space = framed == 32
    double = space[:-1] & space[1:]
    wide = framed.astype(np.uint64)
    for order in ORDERS:
        key = wide[:n].copy()
        bad = double[:n].copy()
        for k in range(1, order):
            key |= wide[k : n + k] << np.uint64(8 * k)
            if k < order - 1:
                bad |= double[k : n + k]
        yield key | np.uint64(order << 40), ~bad, first


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray


def _slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(keys)
    return [(h >> np.uint64(20 * k)) & np.uint64(size - 1) for k in range(SLOTS)]


def build(languages: list[str], grams: list[np.ndarray]) -> Model:
    """The shared table: at least eight slots for each n-gram of the largest filter, a power of two."""
    most, n = max([1, *(len(g) for g in grams)]), len(languages)
    size = 1 << min(20, max(12, int(np.ceil(np.log2(8 * most)))))
    kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if n <= bits), np.uint64)
    table = np.zeros((size, max(1, -(-n // 64))), dtype=kind)
    for l, g in enumerate(grams):
        for s in _slots(g, size):
            table[s, l // 64] |= kind(1 << l % 64)
    filled = np.array([np.mean((table[:, l // 64] >> kind(l % 64)) & kind(1)) for l in range(n)])
    return Model(languages, table, filled**SLOTS)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows whose language isn't null, all their languages."""
    ensure_checkpoint_dir(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    found = sorted(rows.groupBy("l").count().collect(), key=lambda r: (-r["count"], r.l))
    if not found:
        return Model([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0))
    languages = [r.l for r in found]
    scale = 1 << 30
    limit = F.create_map(*[x for r in found for x in (F.lit(r.l), F.lit(int(scale * min(1.0, sample_rows / r["count"]))))])
    number = F.create_map(*[x for i, r in enumerate(found) for x in (F.lit(r.l), F.lit(i))])
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < limit[F.col("l")]).select(number[F.col("l")].alias("l"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "t"):
                l = part.column("l").to_numpy(zero_copy_only=False).astype(np.uint64)
                for keys, good, first in ngrams(part.column("t")):
                    spread = np.repeat(l, np.diff(np.append(first, len(keys))))
                    u, n = np.unique((keys | spread << np.uint64(GRAM_BITS))[good], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["g", "n"])

    counts = sample.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    counts = counts.select((F.col("g") % (1 << GRAM_BITS)).alias("g"), F.shiftright("g", GRAM_BITS).cast("int").alias("l"), "n")
    counts = counts.checkpoint()  # n-grams of the bounded sample
    total = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return build(languages, [np.zeros(0, dtype=np.uint64)] * len(languages))
    by_language = lambda values: F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("l")]
    usual = counts.withColumn("p", F.col("n") / by_language(total)).withColumn("best", F.max("p").over(Window.partitionBy("g")))
    kept = usual.where((F.col("p") >= SHARE * F.col("best")) & (F.col("n") > 1)).select("l", "g", "n", F.pmod(F.xxhash64("g"), F.lit(TIES)).cast("long").alias("tie"))
    cut = cuts(kept.groupBy("l", "n", "tie").agg(F.count("*").alias("m")).toPandas())
    place = F.col("n") * TIES - F.col("tie")
    got = kept.where(place >= by_language({l: cut.get(l, 0) for l in total})).select("l", "g").toPandas()
    of = {l: g.to_numpy().astype(np.uint64) for l, g in got.groupby("l").g}
    return build(languages, [of.get(i, np.zeros(0, dtype=np.uint64)) for i in range(len(languages))])


def cuts(histogram: pd.DataFrame) -> dict[int, int]:
    """For each language the least place (n * TIES - tie) at which its filter has TOP n-grams at most."""
    out = {}
    for l, h in histogram.assign(place=histogram.n * TIES - histogram.tie).groupby("l"):
        h = h.sort_values("place", ascending=False)
        inside = h.place[h.m.cumsum() <= TOP]
        out[int(l)] = int(inside.iloc[-1]) if len(inside) else int(h.place.iloc[0]) + 1
    return out


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, the share of the text's n-grams that the language contains."""
    df = df.drop("lang_pred", "score", "letters_")
    shared = share(df, model)  # at most 8 MB for each 64 languages
    own = df.columns
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in passes(batch, text):
                best, score = _best(m, part.column(text))
                ok = part.column("letters_").to_numpy(zero_copy_only=False)
                names = np.array([*m.languages, "und"], dtype=object)
                lang = np.where(ok & bool(m.languages), names[best], "und")
                columns = [part.column(f) for f in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.where(lang == "und", 0.0, score))], names=schema.names)

    return df.withColumn("letters_", has_letter(F.col(text))).mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _best(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows, n = len(column), len(m.languages)
    if not n:
        return np.zeros(rows, dtype=np.int64), np.zeros(rows)
    places, total = [], np.zeros(rows)
    for keys, good, first in ngrams(column):
        places.append((_slots(keys, len(m.table)), good, first))
        total += np.add.reduceat(good, first, dtype=np.int64)
    kind = m.table.dtype.type
    best, top = np.zeros(rows, dtype=np.int64), np.full(rows, -1.0)
    for word in range(m.table.shape[1]):
        table, masks = np.ascontiguousarray(m.table[:, word]), []
        for (a, b, c), good, first in places:
            mask = table[a] & table[b] & table[c]
            mask[~good] = 0
            masks.append((mask, first))
        for l in range(64 * word, min(n, 64 * word + 64)):
            hits = sum(np.add.reduceat((mask >> kind(l % 64)) & kind(1), first, dtype=np.int64) for mask, first in masks)
            share = np.clip((hits / np.maximum(total, 1) - m.false_rate[l]) / (1 - m.false_rate[l]), 0, 1)
            better = share > top
            best[better], top[better] = l, share[better]
    return best, top


def held_out(key: Column, fold: int) -> Column:
    """Whether crc32 of the key as text, modulo 5, is the fold; a null key is in none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == fold, F.lit(False))


def digest(documents: DataFrame) -> DataFrame:
    """Query op9: learns outside fold 0, predicts every document."""
    d = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 0).alias("held_out"))
    model = fit(d.where(~F.col("held_out")))
    return predict(d.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
