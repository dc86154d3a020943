"""Language-model scores by prediction by partial matching over bytes (operator 8).

The model is a trie of byte contexts up to ORDER bytes, learned from the training rows. A symbol's probability comes from
the longest context in which it was seen; each longer context that is known charges its escape, for which every
distinct symbol gives up ESCAPE of its count, and symbols seen in a longer context are excluded from the shorter ones. Below all contexts every remaining byte is equally likely.
A text's score adds up the log10 probabilities of its symbols; the model is pretrained and doesn't change while scoring.

What is scored is the text's token sequence, as in the base: A-Z lower-cased, words joined by one space, then the end.

The trie is never in one place. Groups of documents send their distinct byte runs with the training counts to shards
by the last two bytes of the context; a shard holds whole subtries of the orders two and up, and answers with the log
probability of each run asked for. Contexts of two bytes that more than one in HOT_ONE_IN training symbols follows are split by
their third byte: there a shard holds subtries of the orders three and up. What these need of order two, and orders zero and
one, are merged before and broadcast: 65,536 counts, and 256 for each of at most HOT_ONE_IN hot contexts. Word counts
for the base score travel in the same way, by word hash. What is sent grows with the corpus: all training rows count.

A shard's task holds one shard of all groups' requests: a few kilobytes a group, and shards grow in number with the groups.
At most MOST_SHARDS are used, so that a row holds dozens of runs; corpora of many terabytes should raise GROUP_BYTES.

Defined results: null and empty texts are the end alone; without training rows every byte has probability 1/256; rows
that are repeated learn and score again; a null key learns; a very long text is one pass of its own and as large as a row may
be; an empty table gives an empty table; other columns pass through, and a column with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .core import ensure_checkpoint_dir, lower_table, mix, non_space_table, passes, prepare, renamed, share, text_bytes, word_hashes, words
from .groups import binary_slices, deal, flat_binary, runs
from .langid import held_out

#: Bytes of the longest context; at most six, so that a run with its symbol fits 64 bits.
ORDER = 5
#: The share of one occurrence that each distinct symbol of a context gives to the escape.
ESCAPE = 0.3
END, SPACE = 10, 32
#: Bytes of a group of documents as stored.
GROUP_BYTES = 4 << 20
#: Shards of runs, and as many of words; a group sends one row to each.
LEAST_SHARDS, MOST_SHARDS = 256, 8192
HOT_ONE_IN = 256
_LOWER, _WORD = lower_table(), non_space_table()
#: The word hash that stands for the end token.
END_TOKEN = np.uint64(0x7F4A7C159E3779B9)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


class Symbols:
    """Byte runs and words of some texts: for each place the run of its context and symbol, for each word its hash."""

    def __init__(self, column: pa.Array):
        data, off = text_bytes(column)
        n = len(off) - 1
        framed = np.full(len(data) + n, END, dtype=np.uint8)
        doc_of_byte = np.repeat(np.arange(n), np.diff(off))
        framed[np.arange(len(data)) + doc_of_byte] = _LOWER[data]
        foff = off + np.arange(n + 1)
        starts, ends, first = words(framed, foff, _WORD)
        self.n_words = np.diff(first)
        self.words = word_hashes(framed, starts, ends)
        self.word_doc = np.repeat(np.arange(n), self.n_words)
        keep = _WORD[framed]
        framed[ends] = SPACE
        keep[ends] = True
        some = self.n_words > 0
        framed[ends[first[1:][some] - 1]] = END
        last = foff[1:][~some] - 1
        framed[last], keep[last] = END, True
        symbol, doc = framed[keep], np.repeat(np.arange(n), np.diff(foff))[keep]
        padded = np.full(len(symbol) + ORDER * (n + 1), END, dtype=np.uint64)
        place = np.arange(len(symbol)) + ORDER * (doc + 1)
        padded[place] = symbol
        key = padded[place].copy()
        for k in range(1, ORDER + 1):
            key |= padded[place - k] << np.uint64(8 * k)
        self.runs, self.doc = key, doc.astype(np.int32)


class Group:
    """Distinct runs and words of a group of documents, in the order in which they go to the shards.

    That order depends on the runs and words alone: a shuffle may hand over the same rows in another order at each reading,
    and the answers to one reading are matched with the runs of another.
    """

    def __init__(self, table: pa.Table, text: str, shards: int, hot: np.ndarray):
        runs_, docs, words_, word_docs, n_words, base = [], [], [], [], [], 0
        for part in passes(table.select([text]), text):
            s = Symbols(part.column(text))
            runs_.append(s.runs)
            docs.append(s.doc + np.int32(base))
            words_.append(s.words)
            word_docs.append(s.word_doc + base)
            n_words.append(s.n_words)
            base += part.num_rows
        self.n = base
        self.n_tokens = np.concatenate([np.zeros(0, dtype=np.int64), *n_words]) + 1
        self.run_doc = np.concatenate([np.zeros(0, dtype=np.int32), *docs])
        self.word_doc = np.concatenate([np.zeros(0, dtype=np.int64), *word_docs, np.arange(base)])
        words_.append(np.full(base, END_TOKEN))
        self.run, self.runs, run_shard = _distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *runs_]), lambda u: _place(u, hot), shards)
        self.word, self.words, word_shard = _distinct(np.concatenate(words_), lambda u: u, shards)
        self.shard = np.concatenate([run_shard, word_shard + shards])

    def message(self, g: int, train: np.ndarray) -> pa.Table:
        counts = [np.bincount(code[train[doc]], minlength=len(keys)) for code, doc, keys in ((self.run, self.run_doc, self.runs), (self.word, self.word_doc, self.words))]
        shard, first = np.unique(self.shard, return_index=True)
        bounds = np.append(first, len(self.shard))
        return pa.table(
            [pa.array(np.full(len(shard), g, dtype=np.int32)), pa.array(shard.astype(np.int32)), binary_slices(np.concatenate([self.runs, self.words]), bounds), binary_slices(np.concatenate(counts).astype(np.uint32), bounds)],
            names=["g", "shard", "keys", "counts"],
        )


def _place(runs_: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash of the part of the context by which a run is dealt: two bytes, of hot contexts three."""
    context = runs_ >> np.uint64(8)
    split = hot[(context & _mask(2)).astype(np.int64)] >= 0
    return mix(np.where(split, context & _mask(3) | np.uint64(1 << 32), context & _mask(2)))


def _distinct(keys: np.ndarray, place, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes into the distinct keys, those keys ordered by shard and value, and their shards."""
    code, unique = pd.factorize(keys)
    shard = (place(unique) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((unique, shard))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[code], unique[order], shard[order]


class Low:
    """Orders zero and one, and order two of the hot contexts: counts of symbols in all, after a byte and after two.

    `hot` has for each context of two bytes its row in the order-two tables, or -1.
    """

    def __init__(self, pairs: np.ndarray, contexts: np.ndarray, triples: np.ndarray):
        one = pairs.reshape(256, 256).astype(np.float64)
        zero = one.sum(axis=0)
        two = triples.reshape(-1, 256).astype(np.float64)
        self.hot = np.full(1 << 16, -1, dtype=np.int32)
        self.hot[contexts] = np.arange(len(contexts), dtype=np.int32)
        self.count = [zero[None, :], one, two]
        self.total = [c.sum(axis=1) for c in self.count]
        self.seen = [(c > 0).sum(axis=1).astype(np.float64) for c in self.count]
        below = [np.zeros((1, 256)), zero[None, :], one[contexts & 255]]
        self.shorter = [((c > 0) * b).sum(axis=1) for c, b in zip(self.count, below, strict=True)]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of each distinct run's symbol in its context, from the counts of all runs of whole subtries.

    Runs in hot contexts come with subtries of three bytes; their order two is in `low`.
    """
    levels = []
    for k in range(ORDER, 1, -1):
        gram, inv = np.unique(keys & _mask(k + 1), return_inverse=True)
        c = np.bincount(inv, weights=counts, minlength=len(gram))
        node, at = np.unique(gram >> np.uint64(8), return_inverse=True)
        levels.append((gram, inv, c, np.bincount(at, weights=c, minlength=len(node)), np.bincount(at, weights=c > 0, minlength=len(node)), at, len(node)))
    symbol = (keys & _mask(1)).astype(np.int64)
    before = (keys >> np.uint64(8) & _mask(1)).astype(np.int64)
    out, done = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    less, out_of = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        if k > 1:
            gram, inv, c, total, seen, at, nodes = levels[ORDER - k]
            if k > 2:
                shorter_gram, _, shorter_count = levels[ORDER - k + 1][:3]
                below = shorter_count[np.searchsorted(shorter_gram, gram & _mask(k))]
                if k == 3:
                    row = low.hot[(gram >> np.uint64(8) & _mask(2)).astype(np.int64)]
                    of = np.flatnonzero(row >= 0)
                    below[of] = low.count[2][row[of], (gram[of] & _mask(1)).astype(np.int64)]
            else:
                below = low.count[1][(gram >> np.uint64(8) & _mask(1)).astype(np.int64), (gram & _mask(1)).astype(np.int64)]
            shorter = np.bincount(at, weights=below * (c > 0), minlength=nodes)[at[inv]]
            c, total, seen = c[inv], total[at[inv]], seen[at[inv]]
            if k == 2:
                row = low.hot[(keys >> np.uint64(8) & _mask(2)).astype(np.int64)]
                of = np.flatnonzero(row >= 0)
                row = row[of]
                c[of], total[of], seen[of], shorter[of] = low.count[2][row, symbol[of]], low.total[2][row], low.seen[2][row], low.shorter[2][row]
        else:
            row = before if k else np.zeros(len(keys), dtype=np.int64)
            c, total, seen, shorter = low.count[k][row, symbol], low.total[k][row], low.seen[k][row], low.shorter[k][row]
        left, kinds = total - less, seen - out_of
        live = ~done & (left > 0)
        hit, escaped = live & (c > 0), live & (c == 0)
        out[hit] += np.log10((c[hit] - ESCAPE) / left[hit])
        out[escaped] += np.log10(ESCAPE * kinds[escaped] / left[escaped])
        done |= hit
        less, out_of = shorter, seen
    out[~done] -= np.log10(256 - out_of[~done])
    return out


def _answer(low: Low, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges the counts of a shard and answers every group, in its order; a shard's first row has its totals."""
        for t in runs(batches, "shard"):
            keys, n = flat_binary(t.column("keys"), np.uint64)
            counts, _ = flat_binary(t.column("counts"), np.uint32)
            code, unique = pd.factorize(keys)
            total = np.bincount(code, weights=counts, minlength=len(unique))
            types, tokens = np.zeros(t.num_rows, dtype=np.int64), np.zeros(t.num_rows, dtype=np.int64)
            if t.column("shard")[0].as_py() < shards:
                values = log_probabilities(unique, total, low).astype(np.float32)
            else:
                values = total
                types[0], tokens[0] = int((total > 0).sum()), int(total.sum())
            yield pa.RecordBatch.from_arrays(
                [t.column("g").combine_chunks(), t.column("shard").combine_chunks(), binary_slices(values[code], np.concatenate([[0], np.cumsum(n)])), pa.array(types), pa.array(tokens)],
                names=["g", "shard", "values", "types", "tokens"],
            )

    return run


def _triples(runs_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of a symbol after two bytes, and their counts."""
    symbols = runs_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].T
    present = np.zeros(256, dtype=bool)
    for x in symbols:
        present[x] = True
    used = np.flatnonzero(present)
    n = len(used)
    if n > 160:  # a table of all triples would be larger than the text
        key, count = np.unique(runs_ & _mask(3), return_counts=True)
        return key.astype(np.int64), count
    rank = np.zeros(256, dtype=np.int32)
    rank[used] = np.arange(n)
    table = np.bincount(rank[symbols[0]] + rank[symbols[1]] * np.int32(n) + rank[symbols[2]] * np.int32(n * n), minlength=n**3)
    some = np.flatnonzero(table)
    return used[some // (n * n)] << 16 | used[some // n % n] << 8 | used[some % n], table[some]


def low_orders(rows: DataFrame, text: str) -> Low:
    """Counts of symbols after a byte, and after the hot pairs of bytes: a bounded number whatever the input's size."""
    ensure_checkpoint_dir(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, text):
                key, n = _triples(Symbols(part.column(text)).runs)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["p", "n"])

    triples = rows.select(text).mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).checkpoint()

    def table(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = keyed.groupBy("p").agg(F.sum("n").alias("n")).toArrow()
        return got.column("p").to_numpy(), got.column("n").to_numpy()

    pairs, followed = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for counts, key in ((pairs, F.col("p") % (1 << 16)), (followed, F.shiftright("p", 8))):
        p, n = table(triples.select(key.alias("p"), "n"))
        counts[p] = n
    contexts = np.flatnonzero(followed * HOT_ONE_IN > followed.sum())
    hot = np.zeros((len(contexts), 256), dtype=np.int64)
    if len(contexts):
        p, n = table(triples.where(F.shiftright("p", 8).isin(contexts.tolist())))
        hot[np.searchsorted(contexts, p >> 8), p & 255] = n
    return Low(pairs, contexts, hot)


def score(df: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score; learns from the rows where `train` holds."""
    new = StructType([StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("known_", DoubleType()), StructField("score", DoubleType())])
    prepare(df.sparkSession)
    chosen = df.withColumn("train_", F.coalesce(train, F.lit(False)))
    df, names = renamed(chosen, {"n_tokens", "n_known", "train_tokens", "base_score", "score"})
    marked = df.withColumnRenamed(names.pop("train_"), "train_")
    df, text, key = marked.drop("train_"), names[text], names[key]
    low = share(df, low_orders(marked.where("train_"), text))
    dealt, groups, _ = deal(marked, text, key, GROUP_BYTES)
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, groups // 4))
    fields = df.schema.fields
    schema = StructType([*fields, *new.fields])

    def ask(table: pa.Table) -> pa.Table:
        train_ = table.column("train_").combine_chunks().to_numpy(zero_copy_only=False)
        return Group(table, text, shards, low.value.hot).message(table.column("g")[0].as_py(), train_)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answer(low.value, shards)(batches)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [left.column(f.name) for f in fields]
        if not left.num_rows:
            return pa.table([*own, *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=schema.names)
        group = Group(left, text, shards, low.value.hot)
        right = right.sort_by("shard")
        ours = pc.less(right.column("shard"), shards)
        chance, _ = flat_binary(right.filter(ours).column("values"), np.float32)
        count, _ = flat_binary(right.filter(pc.invert(ours)).column("values"), np.float64)
        count = count[group.word]
        bins = lambda doc, w: np.bincount(doc, weights=w, minlength=group.n)
        return pa.table(
            [*own, pa.array(group.n_tokens), pa.array(bins(group.word_doc, count > 0).astype(np.int64)), pa.array(bins(group.word_doc, np.log10(count + 0.5))), pa.array(bins(group.run_doc, chance.astype(np.float64)[group.run]))],
            names=schema.names,
        )

    messages = dealt.groupBy("g").applyInArrow(ask, "g int, shard int, keys binary, counts binary")
    answers = messages.repartition("shard").sortWithinPartitions("shard", "g").mapInArrow(answer, "g int, shard int, values binary, types long, tokens long")
    totals = answers.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types_"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"))
    out = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(finish, schema).crossJoin(F.broadcast(totals))  # one row
    base = F.col("known_") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("types_") + 1))
    return out.withColumn("base_score", base).select(*[F.col(n).alias(c) for c, n in names.items()], "n_tokens", "n_known", "train_tokens", "base_score", "score")


def digest(documents: DataFrame) -> DataFrame:
    """Query op8: learns from the documents outside fold 1, scores all."""
    d = documents.select("doc_id", "text", held_out(F.col("doc_id"), 1).alias("held_out"))
    out = score(d, ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
