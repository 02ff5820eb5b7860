"""Optional pictures of plot-ready tables, drawn on the driver from all of one document's rows. The tables are the product; nothing else needs this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _axes():
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as e:
        raise RuntimeError("pictures need matplotlib; the series are tables without it") from e
    return pyplot.subplots(figsize=(12, 5))


def save_series(series: DataFrame, doc_id, path: str, kind: str = "line") -> None:
    """series (doc_id, midpoint, values…) of one document as lines, stacked bars ("bar") or stacked areas ("area")."""
    rows = series.where(F.col("doc_id") == doc_id).orderBy("midpoint").toPandas().drop(columns="doc_id").set_index("midpoint")
    figure, axes = _axes()
    rows.plot(kind=kind, stacked=kind in ("bar", "area"), ax=axes, xlabel="sentence")
    figure.savefig(path)


def save_network(tables: dict[str, DataFrame], doc_id, path: str) -> None:
    """One document's network, from the tables of runners.network()."""
    nodes = tables["node_style"].join(tables["places"], ["doc_id", "node_id"]).where(F.col("doc_id") == doc_id).toPandas()
    edges = tables["edge_style"].where(F.col("doc_id") == doc_id).toPandas()
    at = {r.node_id: (r.x, r.y) for r in nodes.itertuples()}
    figure, axes = _axes()
    for e in edges.itertuples():
        (x1, y1), (x2, y2) = at[e.src], at[e.dst]
        axes.plot([x1, x2], [y1, y2], color="grey", linewidth=e.width, alpha=e.alpha, zorder=1)
    axes.scatter(nodes["x"], nodes["y"], s=nodes["size"], c=nodes["colour"], cmap="tab20", linewidths=nodes["border"], edgecolors="black", zorder=2)
    figure.savefig(path)
