import numpy as np
import pytest

from corpusloom.operators import concepts, graph


def g(n, edges):
    e = np.array(edges, int).reshape(-1, 2)
    return n, e[:, 0], e[:, 1], np.ones(len(e))


def test_path():
    c = graph.solve(*g(4, [(0, 1), (1, 2), (2, 3)]))
    assert np.allclose(c["degree"], [1 / 3, 2 / 3, 2 / 3, 1 / 3]) and np.allclose(c["betweenness"], [0, 2 / 3, 2 / 3, 0]) and np.allclose(c["closeness"], [3 / 6, 3 / 4, 3 / 4, 3 / 6])
    assert np.isclose(c["pagerank"].sum(), 1)


def test_star():
    c = graph.solve(*g(4, [(0, 1), (0, 2), (0, 3)]))
    assert np.allclose(c["betweenness"], [1, 0, 0, 0]) and np.allclose(c["closeness"], [1, 0.6, 0.6, 0.6])
    assert np.allclose(c["eigenvector"], np.array([np.sqrt(3), 1, 1, 1]) / np.sqrt(6), atol=1e-4)


def test_isolated():
    c = graph.solve(*g(4, [(0, 1), (1, 2), (0, 2)]))
    assert np.allclose(c["closeness"], [2 / 3] * 3 + [0]) and np.isclose(c["pagerank"].sum(), 1) and c["pagerank"][3] < c["pagerank"][0]
    assert graph.solve(*g(1, []))["degree"][0] == 1


def test_louvain():
    edges = [(a + s, b + s) for s in (0, 5) for a in range(5) for b in range(a + 1, 5)] + [(4, 5)]
    n, a, b, w = g(10, edges)
    of = graph.louvain(n, a, b, w)
    assert of.tolist() == [0] * 5 + [1] * 5
    m = np.zeros((n, n))
    m[a, b] = m[b, a] = w
    assert graph.modularity(m, of) > graph.modularity(m, np.arange(n))
    assert graph.louvain(*g(3, [])).tolist() == [0, 1, 2]


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50.0, 50.0]]])
    labels = concepts.density_clusters(x)
    assert len(set(labels[:20])) == len(set(labels[20:40])) == 1 and labels[0] != labels[20] and labels[-1] == -1
    assert (concepts.density_clusters(x[:3]) == -1).all()


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [2.0, 0.1]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (1, 3, [0.0, 0.0])]
    return spark.createDataFrame(rows, "doc_id long, node_id long, vector array<float>")


def test_network(nodes):
    edges = graph.similarity_edges(nodes)
    assert [(r.doc_id, r.src, r.dst) for r in edges.collect()] == [(1, 0, 1)]
    d = {(r.doc_id, r.node_id): r.degree for r in graph.degree_centrality(nodes, edges).collect()}
    assert d == {(1, 0): 1 / 3, (1, 1): 1 / 3, (1, 2): 0.0, (1, 3): 0.0, (2, 0): 1.0}
    central, found = graph.centralities(nodes, edges), graph.communities(nodes, edges)
    assert found.count() == central.count() == 5
    style = {(r.doc_id, r.node_id): r["size"] for r in graph.node_style(central, found).collect()}
    assert style[(1, 0)] == 2500 and style[(1, 2)] == 500 and style[(2, 0)] == 500
    assert graph.edge_style(edges, central).first().width == 0.5


def test_places_and_errors(nodes):
    edges = graph.similarity_edges(nodes)
    a, b = (sorted(map(tuple, graph.places(nodes, edges).collect())) for _ in range(2))
    assert a == b and len(a) == 5
    fields = {"x": "double"}
    got = graph._per_document(nodes, edges, fields, lambda n, *g: {"x": np.ones(n)} if n < 4 else 1 / 0, errors=True).collect()
    assert {(r.doc_id, r.x, (r.error or "")[:17]) for r in got} == {(1, None, "ZeroDivisionError"), (2, 1.0, "")}


def test_pictures_hold_all_rows(spark, monkeypatch):
    from unittest.mock import MagicMock

    from corpusloom.plans import plots

    figure, axes = MagicMock(), MagicMock()
    monkeypatch.setattr(plots, "_axes", lambda: (figure, axes))
    monkeypatch.setattr(plots, "MOST", 1, raising=False)
    styles = spark.createDataFrame([(1, i, 1.0, 0, 1.0) for i in range(3)], "doc_id long, node_id long, size double, colour int, border double")
    places = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(3)], "doc_id long, node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 0, 1, 1.0, 1.0), (1, 1, 2, 1.0, 1.0)], "doc_id long, src long, dst long, width double, alpha double")
    plots.save_network({"node_style": styles, "places": places, "edge_style": edges}, 1, "x.png")
    assert axes.plot.call_count == 2 and len(axes.scatter.call_args.args[0]) == 3


def test_errors_do_not_stop_a_run(spark, nodes, monkeypatch):
    from corpusloom.plans import runners

    out = runners.network(nodes, errors=True)
    assert out["errors"].count() == 0 and out["node_style"].count() == 5 and out["edge_style"].count() == 1
    # a network beyond the bound of one task fails alone
    fields, run = {"x": "double"}, lambda n, *e: {"x": np.ones(n)}
    monkeypatch.setattr(graph, "LARGEST", 3)
    real = graph._per_document(nodes, out["edges"], fields, lambda n, *e: run(n) if n <= 3 else 1 / 0, errors=True)
    assert {r.doc_id for r in real.where("error is not null").collect()} == {1} and real.where("doc_id = 2").first().x == 1.0


def test_text_networks(spark):
    docs = spark.createDataFrame([(1, "the old house is by the river. An old house can see the big boats of it."), (2, "")], "doc_id long, text string")
    out = runners_of().text_networks(docs, least=0.05)
    assert out["nodes"].count() > 2 and out["errors"].count() == 0 and out["centrality"].count() == out["nodes"].count()


def runners_of():
    from corpusloom.plans import runners

    return runners


def test_networks_of_vectors_are_those_of_their_edges(spark, monkeypatch):
    """Of any size, without a table of edges: before, a network beyond LARGEST nodes was an error, and all pairs went through a join."""
    from corpusloom.operators import similar

    rng = np.random.default_rng(3)
    rows = [(d, int(k), [None] if k == 5 else rng.normal(size=3 if k % 9 == 0 else 4).round(1).tolist()) for d, n in ((1, 60), (2, 1), (3, 2), (4, 25)) for k in range(n)] + [(1, 100, None), (1, 101, [0.0] * 4)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, vector array<float>")
    for name, value in (("PAIRED", 7), ("SOURCES", 9), ("BYTES", 4000)):
        monkeypatch.setattr(similar, name, value)
    unit = {(d, k): None if v is None else np.zeros(len(v)) if None in v else np.float32(v).astype(float) for d, k, v in rows}
    want = set()
    for d, i in unit:
        for e, j in unit:
            a, b = unit[d, i], unit[e, j]
            if d == e and i < j and a is not None and b is not None and len(a) == len(b) and a.any() and b.any() and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.3:
                want.add((d, i, j))
    edges = graph.similarity_edges(nodes, 0.3).cache()
    assert {(r.doc_id, r.src, r.dst) for r in edges.collect()} == want and edges.count() == len(want) > 100
    monkeypatch.setattr(graph, "LARGEST", 100)

    def same(got, by_edges):
        names = [c for c in got.columns if c not in ("doc_id", "node_id")]
        a, b = ({(r.doc_id, r.node_id): [r[c] for c in names] for r in df.collect()} for df in (got, by_edges))
        assert a.keys() == b.keys() == unit.keys()
        assert all(np.allclose(a[k], b[k], atol=1e-9, equal_nan=True) for k in a)

    central = graph.centralities(nodes, edges).cache()
    same(similar.degree(nodes, 0.3), central.select("doc_id", "node_id", "degree"))
    same(similar.centralities(nodes, 0.3), central)
    same(similar.communities(nodes, 0.3), graph.communities(nodes, edges))
    monkeypatch.setattr(graph, "LARGEST", 10)
    assert similar.paths(nodes, 0.3).count() == len(unit)


def test_clusters_hold_no_matrix_of_all_pairs():
    """Before, three matrices of all distances; 4,000 nodes took over 380 MB."""
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(4000, 2))
    tracemalloc.start()
    labels = concepts.density_clusters(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 4000 and most < 120e6
