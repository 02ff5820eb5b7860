"""Connected components of an edge table by repeated contraction, without an edge or label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Tables of at most so many rows (two longs each) are joined by broadcast.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialised table for broadcast if it has few enough rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that the node is connected with.

    Each round sends every node to the smallest of itself and its neighbours and redraws the edges between those. A hub's edges
    are reduced within tasks before they meet. Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = materialize(both.groupBy("node").agg(F.least("node", F.min("to")).alias("up")), "steps")
        near = bounded(step)
        if labels is None:
            labels = step.select("node", F.col("up").alias("comp"))
        else:
            old = labels
            moved = old.alias("l").join(near.alias("s"), F.expr("l.comp = s.node"), "left").select("l.node", F.coalesce("s.up", "l.comp").alias("comp"))
            labels = materialize(moved, "labels")
        up = near.select(F.col("node").alias("n"), "up")
        drawn = e.join(up, e.a == up.n).select(F.col("up").alias("a"), "b").join(up.withColumnsRenamed({"n": "n2", "up": "up2"}), F.expr("b = n2")).select("a", F.col("up2").alias("b"))
        done = e
        e = materialize(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        discard(done)
    if labels is None:
        return spark.createDataFrame([], "node long, comp long")
    return labels
