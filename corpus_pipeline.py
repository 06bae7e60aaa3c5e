"""A training-corpus pipeline of four stages over the ``documents`` table.

    language_id      rows without a language, or far from every profile, go
    near_dedup       one row of each SimHash group stays: three-word shingles, two differing bits at most
    decontaminate    rows that overlap with a benchmark item go
    sentencepiece    the texts become piece ids; decoding them is compared with the text

Every stage sees whatever the one before it kept, stored as Parquet; all but the last return the
columns they were given. Nulls, empty texts, repeated rows and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.language import keep_known
from tillwatch.llm.sentencepiece import Vocabulary, with_ids
from tillwatch.llm.shipping import ship
from tillwatch.llm.spaced_seeds import keep_clean
from tillwatch.llm.vantage import RADIUS, WORDS, keep_first
from tillwatch.session import remove_path, work_path, workspace

LEAST_CLOSENESS = 0.25  # below it a text is like no learned language
PIECES = "/opt/tokenizers/piece_bpe_32k.model"  # spark.tillwatch.pieces names another model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_known(docs, LEAST_CLOSENESS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_first(docs, words=WORDS, radius=RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, piece_ids, round_trip."""
    ship(spark)
    vocabulary = Vocabulary.load(spark.conf.get("spark.tillwatch.pieces", PIECES))
    found = with_ids(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return found.select(
        "doc_id", "lang", "source", F.size("found.ids").alias("n_pieces"), F.col("found.ids").alias("piece_ids"), "found.round_trip"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Hashing, model fitting and segmentation are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores for itself goes when its result is written, and that when the
    next stage's is; the last stage's own tables go with the caller's ``workspace``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        target = work_path(spark, f"pipeline-{name}")
        with workspace(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(target)
        docs = spark.read.schema(kept.schema).parquet(target)
        if before is not None:
            remove_path(spark, before)
        before = target
    return STAGES[-1][1](spark, docs, sf_dir)
