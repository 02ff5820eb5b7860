"""A rule-based baseline of shallow discourse parsing: a labelled stand-in with the full output shape, not a trained parser.

The first listed connective of a text is its explicit relation; what precedes it is the first argument, what follows the
second. The sense is always Expansion.Conjunction, the direction always forward.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English connectives of one word, by the relation that they most often mark.
CONNECTIVES = tuple(
    """and but or because if when while although however therefore though since unless until before after once so thus hence
    instead otherwise moreover furthermore besides also then nevertheless nonetheless whereas as yet still meanwhile
    consequently accordingly similarly likewise indeed specifically additionally finally afterwards later previously
    nor except rather lest""".split()
)


def encode(text: Column, limit: int | None = None) -> Column:
    """The tokens; the first ``limit`` of them, where given, as the encoder of a trained parser would truncate them (at 512)."""
    tokens = F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), 0)
    return tokens if limit is None else F.slice(tokens, 1, limit)


def parse(docs: DataFrame, connectives: tuple[str, ...] = CONNECTIVES, limit: int | None = None) -> DataFrame:
    """(doc_id, level1, level2, level3, arg1_span, arg2_span, connective, explicit, direction): one relation for each text; without a connective it is implicit and its arguments are empty. The whole text is read, or its first ``limit`` tokens."""
    t = encode(F.coalesce(F.col("text"), F.lit("")), limit)
    at = F.array_min(F.filter(F.transform("t", lambda w, i: F.when(F.lower(w).isin(*connectives), i)), lambda i: i.isNotNull()))
    x = docs.select("doc_id", t.alias("t")).withColumn("at", at)
    joined = lambda start, n: F.array_join(F.slice(F.col("t"), start, n), " ")
    some = F.col("at").isNotNull()
    here = F.coalesce("at", F.lit(0))
    return x.select(
        "doc_id", F.lit("Expansion").alias("level1"), F.lit("Conjunction").alias("level2"), F.lit(None).cast("string").alias("level3"),
        F.when(some, joined(F.lit(1), here)).otherwise("").alias("arg1_span"), F.when(some, joined(here + 2, F.size("t"))).otherwise("").alias("arg2_span"),
        F.when(some, F.get("t", here)).alias("connective"), F.when(some, "true").otherwise("false").alias("explicit"), F.lit("forward").alias("direction"),
    )


FIELDS = ("level1", "level2", "level3", "arg1_span", "arg2_span", "connective", "explicit", "direction")


def parse_with(docs: DataFrame, load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Relations by a parser of one's own, with the columns of parse(): load() makes, once in each Python worker, a function from a text to its relations, dicts of FIELDS (those left out are null)."""

    def run(batches):
        import pandas as pd

        parser = load()
        for pdf in batches:
            rows = [(i, *(r.get(f) for f in FIELDS)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for r in parser(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{f} string" for f in FIELDS))


def to_json(relations: DataFrame) -> DataFrame:
    """(doc_id, json)."""
    return relations.select("doc_id", F.to_json(F.struct(*[c for c in relations.columns if c != "doc_id"])).alias("json"))
