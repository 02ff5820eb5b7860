"""Similarity networks of each document's concepts, with centralities, communities and drawing styles.

What takes a table of edges solves each network in one task, up to LARGEST nodes; ``similar`` works out the networks of vectors
without such a table, of any size. Definitions: degree over n - 1; betweenness and closeness (Wasserman-Faust) unweighted; eigenvector unweighted
by power iteration on A + I; PageRank weighted, damping 0.85, both until the change is below n * 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import min_max
from . import similar

#: Nodes of a network that one task solves at most: the matrices of more would not fit its memory.
LARGEST = 10_000


def similarity_edges(nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, src, dst, weight), src < dst, of nodes (doc_id, node_id, vector): pairs of a document whose cosine is at least ``least``."""
    return similar.edges(nodes, least)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, node_id, degree): neighbours over n - 1; 1 for a lone node."""
    ends = edges.select("doc_id", F.col("src").alias("node_id")).unionByName(edges.select("doc_id", F.col("dst").alias("node_id")))
    counts = ends.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("c"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    x = nodes.select("doc_id", "node_id").withColumn("n", n).join(counts, ["doc_id", "node_id"], "left")
    return x.select("doc_id", "node_id", F.when(F.col("n") > 1, F.coalesce("c", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("degree"))


def solve(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """All five centralities of a graph of n nodes."""
    near: list[list[int]] = [[] for _ in range(n)]
    w = np.zeros((n, n))
    for a, b, x in zip(src, dst, weight, strict=True):
        near[a].append(b)
        near[b].append(a)
        w[a, b] = w[b, a] = x
    between, close = np.zeros(n), np.zeros(n)
    for s in range(n):
        far, paths, before, order = [-1] * n, [0.0] * n, [[] for _ in range(n)], [s]
        far[s], paths[s] = 0, 1.0
        for v in order:
            for u in near[v]:
                if far[u] < 0:
                    far[u] = far[v] + 1
                    order.append(u)
                if far[u] == far[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        total = sum(far[v] for v in order)
        if total > 0 and n > 1:
            close[s] = (len(order) - 1) / total * (len(order) - 1) / (n - 1)
        share = [0.0] * n
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
    if n > 2:
        between /= (n - 1) * (n - 2)
    else:
        between[:] = 0
    a = (w != 0).astype(float)
    x = np.full(n, 1 / n)
    for _ in range(1000):
        y = x + a @ x
        y /= np.linalg.norm(y) or 1
        done = np.abs(y - x).sum() < n * 1e-6
        x = y
        if done:
            break
    else:
        x = np.full(n, np.nan)
    out = w.sum(axis=1)
    step = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    rank = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.85 * (rank @ step + rank[out == 0].sum() / n) + 0.15 / n
        done = np.abs(new - rank).sum() < n * 1e-6
        rank = new
        if done:
            break
    degree = a.sum(axis=1) / (n - 1) if n > 1 else np.ones(n)
    return {"degree": degree, "betweenness": between, "closeness": close, "eigenvector": x, "pagerank": rank}


def modularity(w: np.ndarray, of: np.ndarray) -> float:
    total = w.sum()
    if not total:
        return 0.0
    k = w.sum(axis=1)
    return float(((w - np.outer(k, k) / total) * (of[:, None] == of[None])).sum() / total)


def louvain(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: int = 42) -> np.ndarray:
    """Community of each node of a graph given by its edges: see moved_about."""
    w = np.zeros((n, n))
    w[src, dst] = w[dst, src] = weight
    return moved_about(n, lambda a: w[a], max(1, n), seed)


def moved_about(n: int, rows: Callable[[np.ndarray], np.ndarray], step: int, seed: int = 42) -> np.ndarray:
    """Community of each node: moves by the gain of weighted modularity in seeded order, then the communities as nodes, until nothing moves. rows(a): the weights of nodes a to all, asked for step nodes at a time."""
    of, rng = np.arange(n), np.random.default_rng(seed)
    runs = lambda order: (order[i : i + step] for i in range(0, len(order), step))
    m, k = n, np.concatenate([rows(a).sum(axis=1) for a in runs(np.arange(n))]) if n else np.zeros(0)
    total = k.sum()
    if not total:
        return of
    while True:
        own, mass, moved = np.arange(m), k.copy(), False
        while True:
            changed = False
            for a in runs(rng.permutation(m)):
                g = rows(a)
                g[np.arange(len(a)), a] = 0
                for v, row in zip(a, g, strict=True):
                    mass[own[v]] -= k[v]
                    links = np.bincount(own, row, m)
                    gain = links - mass * k[v] / total
                    gain[(links == 0) & (np.arange(m) != own[v])] = -np.inf
                    best = int(np.argmax(gain))
                    if gain[best] <= gain[own[v]] + 1e-12:
                        best = own[v]
                    changed, own[v] = changed or best != own[v], best
                    mass[best] += k[v]
            moved |= changed
            if not changed:
                break
        if not moved:
            break
        _, own = np.unique(own, return_inverse=True)
        of = own[of]
        by, less = np.argsort(own, kind="stable"), np.zeros((own.max() + 1, own.max() + 1))
        first = np.searchsorted(own[by], np.arange(len(less)))
        for a in runs(np.arange(m)):
            np.add.at(less, own[a], np.add.reduceat(rows(a)[:, by], first, axis=1))
        m, k = len(less), less.sum(axis=1)
        rows = lambda a, g=less: g[a]
    first = {c: i for i, c in reversed(list(enumerate(of)))}
    rank = {c: r for r, c in enumerate(sorted(first, key=first.get))}
    return np.array([rank[c] for c in of])


def layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: int = 42, k: float = 0.5, rounds: int = 50) -> dict[str, np.ndarray]:
    """Places of the nodes by a seeded force layout: all repel each other, edges attract by weight, and the steps shrink."""
    rng = np.random.default_rng(seed)
    at, w = rng.random((n, 2)), np.zeros((n, n))
    w[src, dst] = w[dst, src] = weight
    for r in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 0.01)
        move = (gap * ((k * k / far**2 - w * far / k))[..., None]).sum(axis=1)
        size = np.maximum(np.sqrt((move**2).sum(-1)), 0.01)
        at = at + move * (0.1 * (1 - r / rounds) / size)[:, None]
    return {"x": at[:, 0], "y": at[:, 1]}


def _per_document(nodes: DataFrame, edges: DataFrame, fields: dict[str, str], run, errors: bool = False) -> DataFrame:
    """run on each document's graph. errors: a document on which it fails has null results and the message in a column of that name, and the others go on."""
    kind, names = nodes.schema["doc_id"].dataType.simpleString(), list(fields)

    def solved(left, right):
        import pandas as pd

        ids = np.sort(left["node_id"].to_numpy())
        message = None
        try:
            if len(ids) > LARGEST:
                raise ValueError(f"a network of {len(ids)} nodes is more than one task solves ({LARGEST}); take fewer phrases a document")
            src, dst = (np.searchsorted(ids, right[c].to_numpy()) for c in ("src", "dst"))
            out = pd.DataFrame(run(len(ids), src, dst, right["weight"].to_numpy()))
        except Exception as e:
            if not errors:
                raise
            message = f"{type(e).__name__}: {e}"
            out = pd.DataFrame({c: [None] * len(ids) for c in names})
        out.insert(0, "node_id", ids)
        out.insert(0, "doc_id", left["doc_id"].iloc[0] if len(left) else pd.Series(dtype="int64"))
        if errors:
            out["error"] = message
        return out

    schema = ", ".join([f"doc_id {kind}", "node_id long", *[f"{c} {t}" for c, t in fields.items()], *["error string"] * errors])
    return nodes.select("doc_id", "node_id").groupBy("doc_id").cogroup(edges.groupBy("doc_id")).applyInPandas(solved, schema)


def centralities(nodes: DataFrame, edges: DataFrame, errors: bool = False) -> DataFrame:
    """(doc_id, node_id, degree, betweenness, closeness, eigenvector, pagerank), and error if asked for."""
    return _per_document(nodes, edges, dict.fromkeys(("degree", "betweenness", "closeness", "eigenvector", "pagerank"), "double"), solve, errors)


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 42, errors: bool = False) -> DataFrame:
    """(doc_id, node_id, community_id), numbered by their first nodes, and error if asked for."""
    return _per_document(nodes, edges, {"community_id": "int"}, lambda *g: {"community_id": louvain(*g, seed).astype(np.int32)}, errors)


def places(nodes: DataFrame, edges: DataFrame, seed: int = 42, errors: bool = False) -> DataFrame:
    """(doc_id, node_id, x, y) for drawing, and error if asked for."""
    return _per_document(nodes, edges, {"x": "double", "y": "double"}, lambda *g: layout(*g, seed), errors)


def node_style(central: DataFrame, community: DataFrame) -> DataFrame:
    """Size and border of each node, from degree and eigenvector scaled within the document, and its colour number."""
    own = Window.partitionBy("doc_id")
    x = central.withColumns({"deg": min_max(F.col("degree"), own), "eig": min_max(F.col("eigenvector"), own)}).join(community.select("doc_id", "node_id", "community_id"), ["doc_id", "node_id"])
    return x.select("doc_id", "node_id", (500 + 2000 * F.col("deg")).alias("size"), (1 + 4 * F.col("eig")).alias("border"), (F.col("community_id") % 20).alias("colour"))


def edge_style(edges: DataFrame, central: DataFrame) -> DataFrame:
    """Width and opacity of each edge, from the mean scaled betweenness of its ends."""
    b = central.select("doc_id", "node_id", min_max(F.col("betweenness"), Window.partitionBy("doc_id")).alias("b"))
    x = edges.join(b.toDF("doc_id", "src", "b1"), ["doc_id", "src"]).join(b.toDF("doc_id", "dst", "b2"), ["doc_id", "dst"]).withColumn("b", (F.col("b1") + F.col("b2")) / 2)
    return x.select("doc_id", "src", "dst", (0.5 + 4 * F.col("b")).alias("width"), (0.3 + 0.7 * F.col("b")).alias("alpha"))
