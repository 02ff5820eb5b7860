"""Annotators turn documents into the token relation that every metric reads.

A tokens table has a row for each token: doc_id, sent_id and tok_id (from 0 in the document), text, lemma, pos, dep, head_id
(its own tok_id for the root of a sentence), is_alpha, is_punct, is_space.

RuleAnnotator needs no model: sentences and tokens by regular expression, parts of speech by closed-class word lists and
suffixes, heads by rules over the preceding and following tokens of the sentence. It makes no linguistic claim. A model-backed
annotator has the same interface and runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import blocks
from .blocks import LEXICON as LEXICON

SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
SCHEMA = "doc_id bigint, sent_id int, tok_id int, text string, lemma string, pos string, dep string, head_id int, is_alpha boolean, is_punct boolean, is_space boolean"
SUBORDINATE = ("advcl", "ccomp", "xcomp")


class Annotator(Protocol):
    def tokens(self, docs: DataFrame) -> DataFrame:
        """The tokens table of docs (doc_id, text)."""
        ...


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_id, sentence): the pieces of each text up to its end marks, without those of white space alone."""
    found = F.filter(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SENTENCE), 0), lambda s: s.rlike(r"\S"))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("sent_id", "sentence"))


def with_sentences(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, sent_id, ...) of the rule annotator's sentences with sentence_text."""
    return rows.join(sentences(docs).withColumnRenamed("sentence", "sentence_text"), ["doc_id", "sent_id"], "left")


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out if their files make fewer partitions than there are cores. Only plans without a shuffle are asked, which nothing runs for."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if "Exchange" not in docs._jdf.queryExecution().executedPlan().toString() and docs.rdd.getNumPartitions() < cores:
        return docs.repartition(cores)
    return docs


def annotated(docs: DataFrame, fields: str, make: Callable, *carried: str, id_col: str = "doc_id", text_col: str = "text", block: Callable = blocks.Block) -> DataFrame:
    """(doc_id, fields) of docs, worked out where a text is read. make(block, *carried) gives, of a block of texts, the number of each row's text and the columns, or several such parts; carried: further columns of docs that it takes, as Arrow arrays of the block."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = to_arrow_schema(StructType.fromDDL(f"doc_id {kind}, {fields}"))

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes + 1) // blocks.BLOCK
            for a, b in pairwise(blocks.spans(group).tolist()):
                part = batch.slice(a, b - a)
                made = make(block([t or "" for t in part.column(1).to_pylist()]), *part.columns[2:])
                for of, columns in [made] if isinstance(made, tuple) else made:
                    arrays = [part.column(0).take(pa.array(of)), *[x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]]
                    table = pa.Table.from_arrays(arrays, names=["doc_id", *columns]).select(wanted.names).cast(wanted)
                    yield from table.to_batches(max_chunksize=blocks.ROWS)

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)).mapInArrow(run, f"doc_id {kind}, {fields}")


class RuleAnnotator:
    """Tokens by rules, without a model: see operators.blocks. A row of docs is a document."""

    def tokens(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return annotated(docs, SCHEMA.split(", ", 1)[1], lambda b: (b.tdoc, b.tokens()), id_col=id_col, text_col=text_col)


class ModelAnnotator:
    """A parser of one's own: load() makes, once in each Python worker, a function from a text to rows (sent_id, tok_id, text, lemma, pos, dep, head_id, is_alpha, is_punct, is_space)."""

    def __init__(self, load: Callable[[], Callable[[str], Iterator[tuple]]]):
        self.load = load

    def tokens(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        load = self.load

        def run(batches):
            import pandas as pd

            parse = load()
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            for pdf in batches:
                rows = [(i, *row) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for row in parse(t or "")]
                yield pd.DataFrame(rows, columns=names)

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def _listed(b: blocks.Block, values: pa.Array, name: str) -> tuple:
    offsets = blocks.spans(b.tdoc)
    return b.tdoc[offsets[:-1]], {name: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}


def tokenize_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): token texts in order, of each document that has any."""
    return annotated(docs, "tokens array<string>", lambda b: _listed(b, b.text.cast(pa.string()), "tokens"), id_col=id_col, text_col=text_col)


def lemmatize_tokens(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, lemmas): lemmas of the tokens joined by spaces and parsed again, so their number may change."""
    again = tokens.select(F.col(id_col).alias("doc_id"), F.concat_ws(" ", tokens_col).alias("text"))
    return annotated(again, "lemmas array<string>", lambda b: _listed(b, b.lemmas(), "lemmas"))
