"""Noun-phrase concepts: extraction, normalisation, selection, embedding and density clustering."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: English function words, with the parts that contractions leave behind.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
    she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those
    am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)
PHRASE = ("DET", "ADJ", "NUM", "NOUN")


def noun_chunks(tokens: DataFrame) -> DataFrame:
    """tokens (…) with chunk, the first token of the run of determiners, adjectives, numbers and nouns it belongs to. Runs without a noun are left out."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    x = tokens.select("doc_id", "sent_id", "tok_id", "text", "lemma", "pos", "is_punct", "is_space", F.col("pos").isin(*PHRASE).alias("in_np"))
    x = x.withColumn("start", F.col("in_np") & ~F.coalesce(F.lag("in_np").over(order), F.lit(False)))
    x = x.withColumn("chunk", F.last(F.when(F.col("start"), F.col("tok_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("in_np")
    return x.withColumn("nouns", F.count_if(F.col("pos") == "NOUN").over(Window.partitionBy("doc_id", "sent_id", "chunk"))).where("nouns > 0")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, "^[-'’]+|[-'’]+$", "")


def kept_phrase(phrase: Column) -> Column:
    """False for a lone possessive, dashes alone, and phrases without an ASCII letter."""
    return ~phrase.rlike("^['’]s$") & ~phrase.rlike("^[-–—]+$") & phrase.rlike("[A-Za-z]")


def noun_phrases(tokens: DataFrame, lemmatize: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, phrase_idx, phrase): the distinct normalised noun phrases of each document, in order of first appearance, over all occurrences."""
    x = noun_chunks(tokens)
    word = _stripped(F.lower("lemma")) if lemmatize else F.col("text")
    fine = ~F.col("is_punct") & ~F.col("is_space") & ~F.lower("text").isin("'s", "’s")
    x = x.withColumn("w", word).where((fine & F.col("w").rlike(r"[\p{L}\p{N}]")) if lemmatize else F.lit(True))
    per = x.groupBy("doc_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "w"))), lambda s: s["w"]).alias("ws"))
    left = F.filter("ws", lambda w: ~F.lower(w).isin(*stop_words))
    per = per.withColumn("left", left).where((F.size("left") > 1) | ((F.size("left") == 1) & F.get("left", F.lit(0)).rlike(r"^\p{L}+$")))
    per = per.withColumn("phrase", F.lower(F.trim(F.array_join("left", " ")))).where(kept_phrase(F.col("phrase")))
    first = per.groupBy("doc_id", "phrase").agg(F.min("chunk").alias("at"), F.count(F.lit(1)).alias("occurrences"))
    return first.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "phrase")) - 1).alias("phrase_idx"), "phrase", F.col("occurrences").cast("long").alias("occurrences"))


def top_phrases(phrases: DataFrame, n: int = 100) -> DataFrame:
    """The rows (doc_id, phrase_idx, phrase) whose phrase is among the n commonest of its document (ties: first seen); every occurrence stays. On phrases that are distinct already these are the first n."""
    own, per = Window.partitionBy("doc_id", "phrase"), Window.partitionBy("doc_id")
    x = phrases.withColumn("_c", F.count(F.lit(1)).over(own)).withColumn("_first", F.min("phrase_idx").over(own))
    # a phrase's rows rank alike
    return x.withColumn("_r", F.dense_rank().over(per.orderBy(F.desc("_c"), "_first"))).where(F.col("_r") <= n).drop("_c", "_first", "_r")


class Embedder(Protocol):
    def embed(self, phrases: DataFrame) -> DataFrame:
        """phrases (…, phrase) with vector array<float>."""
        ...


class NGramEmbedder:
    """Hashed character n-grams, of unit length: needs no model."""

    def __init__(self, dim: int = 64, n: int = 3):
        self.dim, self.n = dim, n

    def embed(self, phrases: DataFrame) -> DataFrame:
        padded = F.concat(F.lit("#"), F.col("phrase"), F.lit("#"))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - self.n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr(padded, i, F.lit(self.n))), F.lit(2 * self.dim)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda d: (F.size(F.filter("_g", lambda g: g == d)) - F.size(F.filter("_g", lambda g: g == d + self.dim))).cast("double"))
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
        x = phrases.withColumn("_g", grams).withColumn("_v", counts)
        return x.withColumn("vector", F.transform("_v", lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)).cast("float"))).drop("_g", "_v")


_MASK, _P1, _P2, _P3, _P4, _P5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xxhash64(data: bytes, seed: int = 42) -> int:
    """Spark's xxhash64 of a string of less than 32 bytes, unsigned."""
    turn = lambda x, r: (x << r | x >> 64 - r) & _MASK
    h, at = (seed + _P5 + len(data)) & _MASK, 0
    while at + 8 <= len(data):
        lane = int.from_bytes(data[at : at + 8], "little") * _P2 & _MASK
        h, at = (turn(h ^ turn(lane, 31) * _P1 & _MASK, 27) * _P1 + _P4) & _MASK, at + 8
    if at + 4 <= len(data):
        h, at = (turn(h ^ int.from_bytes(data[at : at + 4], "little") * _P1 & _MASK, 23) * _P2 + _P3) & _MASK, at + 4
    for byte in data[at:]:
        h = turn(h ^ byte * _P5 & _MASK, 11) * _P1 & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


@lru_cache(1 << 18)
def _bucket(gram: str, buckets: int) -> int:
    h = xxhash64(gram.encode())
    return (h - (1 << 64) if h >> 63 else h) % buckets


def gram_vectors(phrases: list[str], dim: int, n: int) -> np.ndarray:
    """NGramEmbedder's vectors of the phrases, as rows; n-grams of less than 32 bytes (n up to 7)."""
    sizes, found = [], []
    for p in phrases:
        p = f"#{p}#"
        grams = [_bucket(p[i : i + n], 2 * dim) for i in range(max(len(p) - n + 1, 1))]
        sizes.append(len(grams))
        found += grams
    buckets = np.array(found, np.int64) + np.repeat(np.arange(len(phrases)), sizes) * 2 * dim
    counts = np.bincount(buckets, minlength=len(phrases) * 2 * dim).reshape(-1, 2 * dim)
    v = (counts[:, :dim] - counts[:, dim:]).astype(float)
    norm = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


class ModelEmbedder:
    """load() makes, once in each Python worker, a function from a list of phrases to an array of vectors."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load = load

    def embed(self, phrases: DataFrame) -> DataFrame:
        load, schema = self.load, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in phrases.schema)

        def run(batches):
            model = load()
            for pdf in batches:
                yield pdf.assign(vector=list(np.asarray(model(pdf["phrase"].tolist()), np.float32)))

        return phrases.mapInPandas(run, f"{schema}, vector array<float>")


def density_clusters(x: np.ndarray, least: int = 5) -> np.ndarray:
    """HDBSCAN labels of the rows of x (-1: noise): mutual reachability, minimum spanning tree, condensed tree, excess of mass."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    square = (x * x).sum(axis=1)
    # distances are worked out again for each node that the tree takes, never held for all pairs
    step = max(1, (16 << 20) // (8 * n))
    core = np.empty(n)
    for i in range(0, n, step):
        d = np.sqrt(np.maximum(square[i : i + step, None] + square[None] - 2 * x[i : i + step] @ x.T, 0))
        d[np.arange(len(d)), np.arange(i, i + len(d))] = 0
        core[i : i + step] = np.partition(d, min(least, n) - 1, axis=1)[:, min(least, n) - 1]
    inside, best, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.sqrt(np.maximum(square + square[at] - 2 * (x @ x[at]), 0)), np.maximum(core, core[at]))
        closer = ~inside & (reach < best)
        best[closer], via[closer] = reach[closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[at], via[at], at))
    edges.sort()
    parent, kids, height, sizes = list(range(2 * n - 1)), {}, {}, [1] * n + [0] * (n - 1)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (h, a, b) in enumerate(edges):
        a, b, new = top(a), top(b), n + k
        parent[a] = parent[b] = new
        kids[new], height[new], sizes[new] = (a, b), h, sizes[a] + sizes[b]

    # the leaves below a node stand together
    start, leaf = np.zeros(2 * n - 1, int), np.zeros(n, int)
    for i in range(2 * n - 2, n - 1, -1):
        a, b = kids[i]
        start[a], start[b] = start[i], start[i] + sizes[a]
    leaf[start[:n]] = np.arange(n)

    lam = lambda h: 1 / h if h > 0 else 1e12
    clusters, order = {}, []  # number: (birth, stability, members, children)
    todo = [(2 * n - 2, 0.0, None)]
    while todo:
        node, birth, above = todo.pop()
        number, stability, members, children, at = len(order), 0.0, leaf[start[node] : start[node] + sizes[node]], [], node
        order.append(number)
        while at in kids:
            a, b = kids[at]
            level = lam(height[at])
            if sizes[a] >= least and sizes[b] >= least:
                stability += (sizes[a] + sizes[b]) * (level - birth)
                children = [a, b]
                break
            for gone in [c for c in (a, b) if sizes[c] < least]:
                stability += sizes[gone] * (level - birth)
            big = [c for c in (a, b) if sizes[c] >= least]
            if not big:
                break
            at = big[0]
        clusters[number] = [stability, members, []]
        if above is not None:
            clusters[above][2].append(number)
        if children:
            level = lam(height[at])
            todo += [(c, level, number) for c in children]
    chosen = {}
    for number in reversed(order):
        stability, _, below = clusters[number]
        inner = sum(clusters[c][0] for c in below)
        if number == 0 or below and inner > stability:
            clusters[number][0], chosen[number] = inner, False
        else:
            chosen[number] = True
    labels, todo, next_label = np.full(n, -1), [0], 0
    while todo:
        number = todo.pop(0)
        if chosen[number]:
            labels[clusters[number][1]] = next_label
            next_label += 1
        else:
            todo += clusters[number][2]
    return labels


def cluster_embeddings(vectors: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, cluster_id, idx) of vectors (doc_id, idx, vector), clustered within each document; noise is left out."""

    def run(pdf):
        pdf = pdf.sort_values("idx", kind="stable")
        return pdf[["doc_id", "idx"]].assign(cluster_id=density_clusters(np.stack(pdf["vector"].to_numpy()).astype(float), least))[["doc_id", "cluster_id", "idx"]]

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, cluster_id int, idx long").where("cluster_id <> -1")
