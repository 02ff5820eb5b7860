"""The training-data pipeline: quality, exact duplicates, near-duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, exact_dedup, mixing, near_dedup, quality, queries, sentencepiece_codec

#: Documents of a lower score go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, trained on the table labels and these rows, scores at least LEAST_QUALITY.

    Null and empty texts are scored like others; repeated rows score alike and stay or go together; without labels of both
    classes every row stays; columns of any name keep their values; an empty table stays empty.
    """
    return quality.passing(docs, quality.train(docs, common.table(spark, sf_dir, "labels")), LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text (null counts as empty) the one of largest doc_id; of repeated rows one. Nulls in other columns and columns of any name keep their values; an empty table stays empty."""
    return common.take_kept(docs, common.materialize(exact_dedup.exact_dedup(docs), "exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row of smallest doc_id. A null text counts as empty, and empty texts are one class; of repeated rows one stays; columns of any name keep their values; an empty table stays empty."""
    return common.take_kept(docs, common.materialize(near_dedup.near_duplicates(docs), "near"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture; a document that it holds in two epochs comes twice. Null languages and sources are the empty name, empty texts cost nothing; repeated rows are taken or left together; columns of any name keep their values; an empty table stays empty."""
    return mixing.mixed(docs, queries.corpus_levels(), queries.WEIGHTS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact) of every row, a row for each. A null or empty text has no pieces; other columns are left out; an empty table stays empty."""
    return sentencepiece_codec.encoded_and_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]
#: The classifier can't be written in SQL; tests/llm/test_pipeline.py checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written and read again by the next, and what it wrote for itself is deleted then."""
    docs, spent = common.table(spark, sf_dir, "documents"), ()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.materialized_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}", spark, *spent)
        spent = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
