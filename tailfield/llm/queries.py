"""One query per operator, over whole tables, with the SQL that it can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tailfield.llm import contamination, licences, near_duplicates, pages, pieces, quality, repeats, scoring, secrets, spans, spellings, urls, whitening
from tailfield.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf, "documents"))


@query
def op8_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_scans(_table(spark, sf, "documents"))


def piece_model() -> str:
    """The vocabulary file of the queries; only its path is used here, the library reads it on the executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_sentencepiece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.sentencepiece_round_trip(_table(spark, sf, "documents"), piece_model())


@query
def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.decontamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.suffix_dedup(_table(spark, sf, "documents"))


@query
def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.lm_scores(_table(spark, sf, "documents"))


@query
def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.url_filters(_table(spark, sf, "pages"))



@query
def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return pages.html_extraction(_table(spark, sf, "pages"))


@query
def op4_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return licences.license_scans(_table(spark, sf, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.embedding_whitening(_table(spark, sf, "embeddings"))


@query
def op12_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return spans.word_dedup(_table(spark, sf, "documents"))


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.spelling_groups(_table(spark, sf, "documents"))
