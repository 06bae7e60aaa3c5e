"""The named queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.block_tables import document_fingerprints
from tillwatch.llm.common import stored
from tillwatch.llm.conversations import repaired_conversations
from tillwatch.llm.language import identify
from tillwatch.llm.license_scan import scan_licenses
from tillwatch.llm.lm_scoring import score_documents
from tillwatch.llm.personal_data import personal_data
from tillwatch.llm.sentencepiece import Vocabulary, encode_documents
from tillwatch.llm.shipping import ship
from tillwatch.llm.spaced_seeds import contaminated
from tillwatch.llm.spelling import spelling_groups
from tillwatch.llm.token_counts import apply_edits, build_trees, sample_edits
from tillwatch.llm.url_filter import filter_urls, rule_table
from tillwatch.llm.vantage import near_duplicates
from tillwatch.llm.warc import archive_pages

TOKENIZERS = "/opt/tokenizers"  # public vocabulary files; each query has a setting that names another one

# The rules of the URL query.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


@_query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranks = spark.conf.get("spark.tillwatch.ranks", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    trees = stored(build_trees(docs, ranks), "token-trees")
    found = apply_edits(docs, trees, sample_edits(docs), ranks)
    return found.select("doc_id", "n_tokens", "edited_tokens", "edits", "encoded_chars", F.length("text").alias("edited_chars"))


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = Vocabulary.load(spark.conf.get("spark.tillwatch.pieces", f"{TOKENIZERS}/piece_bpe_32k.model"))
    found = encode_documents(docs, vocabulary)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids_sha256", "round_trip")


@_query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = spark.conf.get("spark.tillwatch.pieces", f"{TOKENIZERS}/piece_bpe_32k.model")
    return score_documents(_table(spark, sf_dir, "documents"), pieces)


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf_dir, "conversations"))


@_query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))
