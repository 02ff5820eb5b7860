"""Language-model scores of token chunks. Any scorer that gives (word, logprob) or scores chunks in Arrow batches fits; the default is an add-one unigram model of the corpus."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import words
from .lexical import sentence_words
from .windows import chunks


class LogProbScorer(Protocol):
    def score(self, chunked: DataFrame) -> DataFrame:
        """(doc_id, chunk_id, avg_log_prob) of chunks (doc_id, chunk_id, chunk)."""
        ...


def whitespace_tokens(docs: DataFrame, lowercase: bool = True) -> DataFrame:
    """(doc_id, tokens)."""
    return docs.select("doc_id", words(F.lower("text") if lowercase else F.col("text")).alias("tokens"))


class UnigramScorer:
    """ln((count + 1) / (N + V)) of each token, by the counts of the corpus it is fitted on."""

    def __init__(self, corpus: DataFrame):
        self.freqs = whitespace_tokens(corpus).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))

    def log_probs(self, rows: DataFrame) -> DataFrame:
        """rows (…, word) with log_prob."""
        size = F.broadcast(self.freqs.agg((F.sum("freq") + F.count(F.lit(1))).cast("double").alias("mass")))  # one row
        known = rows.join(self.freqs, "word", "left").crossJoin(size)
        return known.withColumn("log_prob", F.log((F.coalesce("freq", F.lit(0)) + 1) / F.col("mass"))).drop("freq", "mass")

    def score(self, chunked: DataFrame) -> DataFrame:
        # a chunk's distinct words meet the counts once each
        rows = chunked.select("doc_id", "chunk_id", F.explode("chunk").alias("word")).groupBy("doc_id", "chunk_id", "word").agg(F.count(F.lit(1)).alias("n"))
        scored = self.log_probs(rows)
        return scored.groupBy("doc_id", "chunk_id").agg((F.sum(F.col("log_prob") * F.col("n")) / F.sum("n")).alias("avg_log_prob"))


class ModelScorer:
    """load() makes, once in each Python worker, a function from a list of tokens to their mean log-probability."""

    def __init__(self, load: Callable[[], Callable[[list[str]], float]]):
        self.load = load

    def score(self, chunked: DataFrame) -> DataFrame:
        load = self.load

        def run(batches):
            score = load()
            for pdf in batches:
                yield pdf.assign(avg_log_prob=[score(list(c)) for c in pdf["chunk"]])[["doc_id", "chunk_id", "avg_log_prob"]]

        return chunked.select("doc_id", "chunk_id", "chunk").mapInPandas(run, "doc_id bigint, chunk_id int, avg_log_prob double")


class LogitScorer:
    """load() makes, once in each Python worker, a function from a list of tokens to (ids, logits of every position over the vocabulary).

    A chunk's score is the mean, over its tokens, of the log-softmax at the token's own position (shifted: at the position before
    it, which leaves the first token out and makes it a next-token probability).
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], tuple]], shifted: bool = False):
        self.load, self.shifted = load, shifted

    def score(self, chunked: DataFrame) -> DataFrame:
        load, shifted = self.load, self.shifted

        def made():
            import numpy as np

            run = load()

            def mean(tokens: list[str]) -> float | None:
                ids, logits = (np.asarray(x) for x in run(tokens))
                logits = logits.astype(float)
                if shifted:
                    ids, logits = ids[1:], logits[:-1]
                if not len(ids):
                    return None
                top = logits.max(axis=1, keepdims=True)
                log_probs = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
                return float(log_probs[np.arange(len(ids)), ids].mean())

            return mean

        return ModelScorer(made).score(chunked)


def chunk_log_probs(docs: DataFrame, scorer: LogProbScorer, size: int = 2048, stride: int = 0) -> DataFrame:
    """(doc_id, chunk_id, start_token, end_token, avg_log_prob, num_tokens, text_snippet): the snippet is a chunk's first 50 tokens."""
    parts = chunks(whitespace_tokens(docs), size, stride)
    scored = scorer.score(parts)
    shown = parts.select("doc_id", "chunk_id", "start_token", "end_token", "num_tokens", F.concat_ws(" ", F.slice("chunk", 1, 50)).alias("text_snippet"))
    return shown.join(scored, ["doc_id", "chunk_id"]).select("doc_id", "chunk_id", "start_token", "end_token", "avg_log_prob", "num_tokens", "text_snippet")


def document_log_probs(chunk_scores: DataFrame) -> DataFrame:
    """(doc_id, avg_log_prob, num_tokens): the unweighted mean of a document's chunks, and the sum of their tokens."""
    return chunk_scores.groupBy("doc_id").agg(F.avg("avg_log_prob").alias("avg_log_prob"), F.sum("num_tokens").cast("long").alias("num_tokens"))


def surprisal(tokens: DataFrame, scorer: UnigramScorer) -> DataFrame:
    """Per sentence: mean surprisal of its alphabetic tokens, their sample variance (0 for one token), and the mean over the overall mean; to 3 places, 0 without tokens."""
    rows = scorer.log_probs(sentence_words(tokens).select("doc_id", "sent_id", "word", F.size("tok_ids").alias("n")))
    per = rows.groupBy("doc_id", "sent_id").agg(F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("log_prob")).alias("p"), "n"))).alias("ps"))
    return surprisal_of(per, overall_surprisal(tokens, scorer)).drop("ps")


def overall_surprisal(tokens: DataFrame, scorer: UnigramScorer) -> DataFrame:
    """One row (overall): the mean surprisal of all alphabetic tokens. The tokens are counted by word first, in place and then together."""
    words = tokens.where("is_alpha").groupBy(F.lower("text").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return scorer.log_probs(words).agg((-F.sum(F.col("log_prob") * F.col("n")) / F.sum("n")).alias("overall"))


def surprisal_of(per: DataFrame, overall: DataFrame) -> DataFrame:
    """per (doc_id, sent_id, ps array<struct<p, n>>, ...) with the metrics of surprisal."""
    n = F.aggregate("ps", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    mean = F.try_divide(F.aggregate("ps", F.lit(0.0), lambda a, s: a + s["p"] * s["n"]), F.col("_n"))
    spread = F.aggregate("ps", F.lit(0.0), lambda a, s: a + (s["p"] - F.col("_m")) * (s["p"] - F.col("_m")) * s["n"])
    x = per.withColumn("_n", n).withColumn("_m", mean).withColumn("_v", F.when(F.col("_n") > 1, spread / (F.col("_n") - 1)).otherwise(F.lit(0.0)))
    x = x.crossJoin(F.broadcast(overall)).withColumn("_r", F.try_divide(F.col("_m"), F.col("overall")))
    zero = lambda c: F.when(F.col("_n") > 0, F.coalesce(exact_round(c, 3), F.lit(0.0))).otherwise(F.lit(0.0))
    return x.withColumns({"mean_surprisal": zero("_m"), "surprisal_variance": zero("_v"), "normalized_surprisal": zero("_r")}).drop("_n", "_m", "_v", "_r", "overall")
