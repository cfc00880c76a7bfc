"""A corpus pipeline: each stage reads what the last one wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``, and any further columns
that their input has, whatever those are called. Nulls, empty and very long texts, ties,
repeated rows and empty tables have the results that the operators state; a document
without an id is never a copy or a repeat of another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.llm import decontamination, language_id, order_minhash, sentencepiece_codec, suffix_dedup
from icefathom.llm.columns import shield
from icefathom.llm.queries import PIECE_MODEL
from icefathom.session import bound_batches, ensure_checkpoint_dir

#: A text whose best language needs this many bits for each byte, half as much again as
#: even chances need, is written in signs that no known language has.
MOST_BITS = 12.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _over_documents(stage: Stage) -> Stage:
    """Keeps further columns of the input away from the operators and puts them back."""

    @wraps(stage)
    def shielded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner, restore = shield(docs, COLUMNS, ())
        return restore(stage(bound_batches(spark), inner, sf_dir))

    return shielded


@_over_documents
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those no known language explains."""
    trees = language_id.train(docs.filter(~F.coalesce(language_id.held_out(), F.lit(True))))
    if trees is None:
        return docs.limit(0)
    found = language_id.identify(docs, trees)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("bits_per_byte") < MOST_BITS)
    return found.filter(known).select(*docs.columns)


@_over_documents
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document with the least id."""
    ensure_checkpoint_dir(spark)
    found = order_minhash.classes(docs)
    others = found.filter(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


@_over_documents
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a document with no word left goes."""
    ensure_checkpoint_dir(spark)
    kept = suffix_dedup.cut(docs, suffix_dedup.repeats(docs))
    spoken = kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return spoken.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@_over_documents
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find(docs, bench)
    return found.filter(F.size("spans") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    bound_batches(spark)
    coded = sentencepiece_codec.round_trip(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.read_model(PIECE_MODEL))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "exact", "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL has no PPM, order MinHash, alignment or SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
