"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as x6
from . import secret_scan as x4
from . import near_dedup as x9
from . import ann as x8
from . import sentencepiece_codec as x2
from . import line_dedup as x3
from . import mixing as x10
from . import pii as x5
from . import quality as x7
from .common import table
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In increments, as a history grows: the first scan knows two rules; when the third is added, the ledger tells that only it is pending, and for all blobs; the report's own scan finds nothing pending."""
    docs = table(spark, sf_dir, "documents")
    ledger = x4.updated_ledger(docs, rules=x4.RULES[:2])
    ledger = x4.updated_ledger(docs, ledger=ledger)
    return x4.report(x4.scan_paths(docs, ledger=ledger))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x6.exact_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x9.near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x8.nearest(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x2.encoded_and_checked(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x3.line_dedup(table(spark, sf_dir, "pages"))


#: Weights of the test corpus's tree.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2}}


def corpus_levels() -> tuple[tuple[str, Column], ...]:
    """The test corpus's tree: its sources end in a number, whose remainder by 4 is their domain."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1)
    domain = F.concat(F.lit("d"), (F.coalesce(F.when(number != "", number).cast("long"), F.lit(0)) % 4).cast("string"))
    return ("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x10.mixture(table(spark, sf_dir, "documents"), corpus_levels(), WEIGHTS).selectExpr("doc_id", "mix_domain as domain", "mix_lang as lang", "mix_source as source", "mix_tokens as tokens", "mix_epochs as n_epochs")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark redacts the values of settings with "secret" in their names
    key = spark.conf.get("spark.corpusloom.pii.secret", "key of the test corpus")
    return x5.pseudonymised(table(spark, sf_dir, "documents"), key)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x7.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_line_dedup, op4_secret_scan, op5_pii, op6_exact_dedup, op7_quality, op8_nearest, op9_near_dedup, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": x3.ORACLE, "op4_secret_scan": x4.ORACLE, "op6_exact_dedup": x6.ORACLE, "op10_mixing": x10.ORACLE}
