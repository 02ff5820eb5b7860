import random
import re
import zlib

import duckdb
import numpy as np

from corpusloom.llm import ann, mixing, quality
from corpusloom.llm.queries import WEIGHTS, corpus_levels


def test_quality(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r.keep for r in quality.classified(docs, train).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect()]
    good, bad = [k for q, k in held if q == 1], [k for q, k in held if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "a b", "en", "s", 3), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as p_text", "2 as y")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    got = quality.classified(docs, labels).collect()
    assert len(got) == 3 and all(r.p_quality == 1 and r.keep for r in got)
    both = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, quality int")
    more = docs.unionByName(docs.selectExpr("2L as doc_id", "'###' as text", "lang", "source", "n_chars", "p_text", "y"))
    assert quality.classified(more, both).count() == 6
    assert quality.classified(docs.limit(0), labels).count() == 0


def fitted_lengths(monkeypatch, run):
    """Sizes of the documents in each fit of the metadata view; lengths tell the documents."""
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *a: (x.shape[1] == quality.META and seen.append(np.rint(np.expm1(x[:, -3] * 10)).astype(int).tolist())) or fit(x, y, *a))
    run()
    monkeypatch.setattr(quality, "fit", fit)
    return seen


QUALITY_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_pool_is_unlabelled(spark, monkeypatch):
    rows = [(i, f"text {i} " * 5, "en", "s", i) for i in range(60)] + [(None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, QUALITY_DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, None)], "doc_id long, quality int")
    for few in (200_000, 0):
        monkeypatch.setattr(quality, "FEW_LABELS", few)
        # whoever is not less sure than not is handed over, so all of the pool comes
        fits = fitted_lengths(monkeypatch, lambda: quality.train(docs, labels, rounds=1, each=100, sure=0.5))
        assert len(fits[0]) == 32 and set(fits[0]) <= set(range(40))
        assert sorted(fits[-1][32:]) == [1, *range(40, 60)]


def test_quality_pool_has_no_bound(spark, monkeypatch):
    """One document of many thousands is the one that the text view is surest of, wherever it stands."""
    n = 7000
    good, bad, plain = "fine words of a good text " * 8, "### 000 ||| " * 12, "neither this nor that "
    rows = [(i, good if i % 2 else bad, "en", "s", 10) for i in range(100)] + [(i, plain, "en", "s", 20) for i in range(100, n)] + [(n, good * 3, "en", "s", 777)]
    docs = spark.createDataFrame(rows, QUALITY_DOCS).repartitionByRange(8, "doc_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    fits = fitted_lengths(monkeypatch, lambda: quality.train(docs, labels, rounds=1, each=0.025, sure=0.5))
    assert 777 in fits[-1] and len(fits[-1]) <= 80 + 2


def co_trained(docs, labels, rounds, each, sure=0.95):
    """The method with every row in memory, written anew: features of each document by loops, whole sorts instead of histograms."""

    def text(t):
        x, data = np.zeros(quality.TEXT, np.float32), (t or "").encode()
        kinds = [int(quality._CLASS[b]) for b in data]
        for p, q in zip(kinds, kinds[1:]):
            x[p * 16 + q] += 1
        if len(kinds) > 1:
            x[:256] = np.sqrt(x[:256] / (len(kinds) - 1))
        mask, base, hashes = (1 << 64) - 1, 0x9E3779B97F4A7C55, []
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode()):
            h = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) & mask
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
            hashes.append(h ^ h >> 31)
        for h in hashes:
            x[256 + h % 512] += 1
        x[256:768] = np.sqrt(x[256:768] / max(len(hashes), 1))
        x[-3:] = len({h >> 20 for h in hashes}) / max(len(hashes), 1), np.log1p(len(hashes)) / 10, 1
        return x.astype(np.float16).astype(np.float32)

    def meta(r):
        x = np.zeros(quality.META, np.float32)
        x[zlib.crc32(f"lang {r.lang}".encode()) % 64] = x[64 + zlib.crc32(f"source {r.source}".encode()) % 1024] = 1
        size = np.log1p(r.n_chars) / 10
        x[-3:] = size, size * size, 1
        return x

    xs = [np.array([text(r.text) for r in docs]), np.array([meta(r) for r in docs])]
    y = np.array([labels.get(r.doc_id, -1) for r in docs])
    known, pool = sorted(np.flatnonzero(y >= 0), key=lambda i: (y[i], docs[i].tie)), np.flatnonzero(y < 0)
    fit_on = [i for k, i in enumerate(known) if k % 5]
    base, given = np.mean(y[fit_on]), [{}, {}]
    views = lambda: [quality.fit(np.concatenate([x[fit_on], x[list(g)]]), np.concatenate([y[fit_on], list(g.values())])) for x, g in zip(xs, given)]
    w = views()
    for _ in range(rounds):
        new = [{}, {}]
        for k in (0, 1):
            z = dict(zip(pool.tolist(), (xs[k][pool] @ w[k]).astype(float)))
            for label, part, sign in ((1.0, base, 1), (0.0, 1 - base, -1)):
                fine = [i for i in z if i not in given[1 - k] and sign * z[i] >= np.log(sure / (1 - sure))]
                new[1 - k] |= {i: label for i in sorted(fine, key=lambda i: (-sign * z[i], docs[i].tie))[: int(each * len(fit_on) * part)]}
        given = [given[k] | new[k] for k in (0, 1)]
        w = views()
    return quality.finished(xs[0][known], xs[1][known], y[known], w).score(*xs)[:, 2]


def test_quality_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.selectExpr("*", "xxhash64('sample', doc_id) as tie").collect()
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id % 2}
    want = co_trained(rows, known, rounds=2, each=0.1)
    model = quality.train(docs, labels.where("doc_id % 2 = 1"), rounds=2, each=0.1)
    got = {r.doc_id: r.p_quality for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert np.max(np.abs(want - [got[r.doc_id] for r in rows])) < 0.02


def brute(rows, k, every):
    x = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted(x):
        if q % every == 0:
            best = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_ann_edges(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(120)] + [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 1.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (305, [1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as vector")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == brute(rows, 20, 20)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few).collect()) == brute(rows[:5], 20, 20)
    assert ann.nearest(df.limit(0)).count() == 0


def test_ann_recall(spark, sf):
    path = f"{sf.replace('0.001', '0.1')}/embeddings.parquet"
    rows = duckdb.sql(f"select vec_id, embedding from '{path}'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got: dict = {}
    for r in ann.nearest(spark.read.parquet(path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hit.append(len(got[ids[k]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hit) >= 0.9


def hot_vectors(n, noise=None, lengths=False):
    """n random unit vectors of 64 dimensions of which a third are one vector, or near it (noise); or of all lengths."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, 64)))
    if noise is not None:
        hot = rng.random(n) < 1 / 3
        x[hot] = unit(x[0] + noise * unit(rng.normal(size=(hot.sum(), 64))))
    return x * rng.lognormal(0, 1, (n, 1)) if lengths else x


def worst_and_mean_recall(spark, x):
    """Copies of a neighbour count alike."""
    got: dict = {}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hit = []
    for k in range(0, len(x), 20):
        s = x @ x[k]
        s[k] = -np.inf
        hit.append(np.sum(np.array(got[k]) >= np.sort(s)[-20] - 1e-9) / 20)
    return min(hit), np.mean(hit)


def test_ann_recall_with_a_hot_vector(spark):
    assert worst_and_mean_recall(spark, hot_vectors(6000, noise=0))[1] >= 0.9


def test_ann_in_small_shards(spark, monkeypatch):
    """Cells of one and of two pivots, divided ones, shared shards, and several blocks of queries."""
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    for x in (hot_vectors(3000, noise=0.1), hot_vectors(2000, lengths=True), hot_vectors(2000, noise=0)):
        assert worst_and_mean_recall(spark, x)[0] == 1


def test_ann_passes_shards_over(spark, monkeypatch):
    """Vectors in groups: a query is sent to few shards."""
    monkeypatch.setattr(ann, "SHARD", 100)
    rng, sent, keep = np.random.default_rng(3), [], ann.materialize
    centres = rng.normal(size=(40, 64))
    x = centres[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 64))
    monkeypatch.setattr(ann, "materialize", lambda df, name, *a: (lambda out: (name == "others-asked" and sent.append(out)) or out)(keep(df, name, *a)))
    assert worst_and_mean_recall(spark, x)[0] == 1
    pairs = sent[0].selectExpr("sum(size(queries))").first()[0] or 0
    assert pairs < 0.1 * 200 * 40


def test_ann_in_narrow_rows_and_rounds(spark, monkeypatch):
    """no row that is written between steps holds a shard's entries or a block of queries, and a round sends no more than it may."""
    monkeypatch.setattr(ann, "SHARD", 100)
    wide, sent, keep = [], [], ann.materialize

    def kept(df, name, *a):
        out = keep(df, name, *a)
        wide.extend((name, out.selectExpr(f"max(size({c}))").first()[0] or 0) for c, kind in out.dtypes if kind.startswith("array<struct"))
        if name == "others-asked":
            sent.append(out.selectExpr("sum(size(queries))").first()[0] or 0)
        return out

    monkeypatch.setattr(ann, "materialize", kept)
    x = hot_vectors(3000)
    assert worst_and_mean_recall(spark, x)[0] == 1
    assert max(n for _, n in wide) * 64 * 8 <= 1 << 14 and len(sent) == 1
    sent.clear()
    monkeypatch.setattr(ann, "ROUND_BYTES", 7 * 150 * 64 * 8)
    assert worst_and_mean_recall(spark, x)[0] == 1
    assert len(sent) > 3 and max(sent) <= 7 * 150


def test_ann_is_exact_in_full_blocks(spark):
    assert worst_and_mean_recall(spark, hot_vectors(4096))[0] == 1
    assert worst_and_mean_recall(spark, hot_vectors(5000, noise=0.1))[0] == 1


def test_ann_with_vectors_of_all_lengths(spark):
    assert worst_and_mean_recall(spark, hot_vectors(4096, lengths=True))[0] == 1


def test_mixture(spark):
    def rows(source, lang, n, size):
        return [(len(source) * 1000 + i, "x" * size, lang, source, 1) for i in range(n)]

    data = rows("src0", "en", 50, 40) + rows("asrc4", "en", 2, 40) + rows("bbsrc1", "de", 30, 400) + rows("cccsrc1", "fr", 5, 4000) + [(None, None, None, None, None), (9, "", "en", "src2", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as cap", "2 as budget", "3 as place", "'q' as domain")
    out = mixing.mixture(df, corpus_levels(), WEIGHTS)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    total = sum(r.mix_tokens for r in got)
    used = sum(r.mix_tokens * r.mix_epochs for r in got)
    assert len(got) == len(data) and used <= int(total * 0.8) and {r.mix_epochs for r in got} <= {0, 1, 2}
    # the tiny source is exhausted and its sibling takes what it can't supply
    assert all(r.mix_epochs == 2 for r in got if r.source == "asrc4")
    assert mixing.mixture(df.limit(0), corpus_levels(), WEIGHTS).count() == 0


def test_mixture_in_ranges(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.mix_epochs for r in mixing.mixture(docs, corpus_levels(), WEIGHTS).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 1)
    assert {r.doc_id: r.mix_epochs for r in mixing.mixture(docs, corpus_levels(), WEIGHTS).collect()} == whole


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "z", "s4", 1000)], "domain string, lang string, source string, tokens long").selectExpr("*", "1L as docs")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, ("domain", "lang", "source"), 800, 1, {}).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}
