"""A corpus pipeline over `documents`: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs, so a lost executor never costs more than one stage. All but the last return the columns of documents.

In every stage an empty table gives an empty table, nulls may stand in any column, and further columns pass through the
stages that keep columns, whatever their names.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephyspark.llm import bpe, decontam, langid, minhash, substring
from ephyspark.llm.core import ensure_checkpoint_dir, read
from ephyspark.llm.queries import bpe_path

SIMILARITY, SHINGLE_WORDS, WINDOW_WORDS, LEAK_WORDS = 0.8, 5, 20, 10


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _keeps_columns(stage):
    """A stage that returns the columns it was given; further columns can't clash with names that operators use."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        other = {c: f"other{i}_" for i, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.withColumnsRenamed(other), sf_dir)
        return out.withColumnsRenamed({n: c for c, n in other.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])

    return run_stage


@_keeps_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), and those in no language that the labels teach, go; a
    missing label is filled in. Repeated rows are judged alike."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 0)))
    judged = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= langid.REJECT_BELOW))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@_keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id; null ids come last.

    Each row is judged by its own text, whatever its id; rows with equal doc_id and text are one document.
    """
    keyed = docs.withColumn("key_", F.xxhash64("doc_id", "text"))
    judged = minhash.near_duplicates(keyed, SIMILARITY, SHINGLE_WORDS, key="key_").select("key_", "component_id").distinct()
    ids = keyed.select("key_", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("least")
    kept = judged.join(ids, "key_").groupBy("component_id").agg(least).select("least.key_")
    return keyed.dropDuplicates(["key_"]).join(kept, "key_", "left_semi").drop("key_")


@_keeps_columns
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus go; untouched texts stay as they are, emptied ones go.

    Null, empty and short texts are untouched; of rows with equal ids the order of texts decides which comes first.
    """
    out = substring.remove_repeats(docs, width=WINDOW_WORDS).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


@_keeps_columns
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go; null and empty texts stay, repeated rows go or stay together."""
    return decontam.mark(docs, read(spark, sf_dir, "benchmark"), width=LEAK_WORDS).where(F.size("hit_spans") == 0).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back.

    A null or empty text has no tokens; each row is encoded on its own, repeated ones too; other columns are left out.
    """
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), bpe_path())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("bpe_tokens", encode_tokens),
]

#: SQL can express neither the language model nor the token merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is kept under the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
