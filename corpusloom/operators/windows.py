"""Windows over the sentences of a document, and chunks over its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_round


def ordered_mean(x: str, by: str = "sent_id") -> Column:
    """Aggregate: mean of the values that aren't null, added in order."""
    values = F.filter(F.array_sort(F.collect_list(F.struct(F.col(by), F.col(x).cast("double").alias("x")))), lambda s: s["x"].isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, s: a + s["x"]), F.size(values))


def tumbling(rows: DataFrame, size: int, means: list[str], firsts: list[str] = (), nullable: list[str] = (), round_to: int = 2) -> DataFrame:
    """Windows of size sentences each; the last one of a document may be shorter.

    means are averaged and rounded; nullable ones too, unless the window's first sentence has none, which makes the window's
    value null; firsts keep the value of the first sentence. Adds window_id, start_sentence and end_sentence.
    """
    aggs = [ordered_mean(c).alias(f"_{c}") for c in [*means, *nullable]]
    aggs += [F.min_by(F.struct(c), "sent_id")[c].alias(c) for c in firsts]
    aggs += [F.min_by(F.struct(F.col(c).isNotNull().alias("v")), "sent_id")["v"].alias(f"_has_{c}") for c in nullable]
    grouped = rows.withColumn("window_id", F.floor(F.col("sent_id") / size)).groupBy("doc_id", "window_id")
    out = grouped.agg(F.min("sent_id").cast("long").alias("start_sentence"), F.max("sent_id").cast("long").alias("end_sentence"), *aggs)
    shown = [exact_round(f"_{c}", round_to).alias(c) for c in means] + [F.when(F.col(f"_has_{c}"), exact_round(f"_{c}", round_to)).alias(c) for c in nullable]
    return out.select("doc_id", "window_id", "start_sentence", "end_sentence", *shown, *firsts)


def sliding(rows: DataFrame, size: int, means: list[str], firsts: list[str] = (), round_to: int = 2) -> DataFrame:
    """Every full window of size sentences, a sentence apart; shorter documents have none."""
    frame = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(0, size - 1)
    x = rows.withColumn("_n", F.count(F.lit(1)).over(frame)).withColumn("end_sentence", F.max("sent_id").over(frame).cast("long"))
    for c in means:
        values = F.filter(F.collect_list(F.struct(F.col(c).cast("double").alias("x"))).over(frame), lambda s: s["x"].isNotNull())
        x = x.withColumn(f"_{c}", F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, s: a + s["x"]), F.size(values)))
    x = x.where(F.col("_n") == size)
    return x.select("doc_id", F.col("sent_id").cast("long").alias("start_sentence"), "end_sentence", *[exact_round(f"_{c}", round_to).alias(c) for c in means], *firsts)


def chunks(docs: DataFrame, size: int = 2048, stride: int = 0, tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, chunk_id, start_token, end_token, num_tokens, chunk) of docs (doc_id, tokens): runs of size tokens, of which neighbours share stride. The last may be shorter, and may lie within the one before."""
    n = F.size(tokens_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - stride)))
    x = docs.select("doc_id", tokens_col, F.posexplode(starts).alias("chunk_id", "start_token"))
    out = x.withColumn("chunk", F.slice(F.col(tokens_col), F.col("start_token") + 1, F.lit(size)))
    return out.select("doc_id", "chunk_id", "start_token", (F.col("start_token") + F.size("chunk")).alias("end_token"), F.size("chunk").alias("num_tokens"), "chunk")
