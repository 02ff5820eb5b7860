import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bagminhash, common, exact_dedup, near_dedup
from corpusloom.llm.components import connected_components

DOC = "doc_id long, text string, n long, keep_id string, gid string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOC)


def exact_model(rows):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, won = max(known, default=None), False
        for i in ids:
            kept = i == keep and not won
            won |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [0, 16 << 20])
def test_exact(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "WIDTHS", (2, 3, 5))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bound)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 8)))) for i in range(60)]
    rows += [(100, "x" * 40), (101, "x" * 40), (101, "x" * 40), (102, "x" * 41), (103, None), (None, "é" * 9), (None, "é" * 9), (7, "é" * 9), (8, "x" * 40 + "y")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == exact_model(rows)


@pytest.mark.parametrize("bound", [0, 16 << 20])
def test_exact_with_shared_tags(spark, monkeypatch, bound):
    """Slices that share a tag stay apart in the result, whatever the tags."""
    monkeypatch.setattr(exact_dedup, "WIDTHS", (2, 3, 5))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bound)
    tagged = exact_dedup.tagged
    monkeypatch.setattr(exact_dedup, "tagged", lambda cut, level: F.pmod(tagged(cut, level), F.lit(5)))
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 5)))) for i in range(40)] + [(100, "x" * 40), (101, "x" * 40), (102, "x" * 41), (None, None)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == exact_model(rows)


def test_exact_joins_no_slices(spark, monkeypatch):
    """Long slices of few groups don't make a join shuffle the texts."""
    plans, keep = {}, exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, name))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 4096)
    rows = [(i, f"{i // 2:04}" * 1000) for i in range(40)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == exact_model(rows)
    assert all("strategy=broadcast" in plans[f"split{level}"] for level in range(3))


def test_exact_at_the_real_widths(spark):
    """Texts that differ in one byte on either side of each width, and copies beyond the widest fixed one."""
    rows, n = [], 0
    for edge in (64, 64 + (1 << 10), 64 + (1 << 10) + (1 << 14), 64 + (1 << 10) + (1 << 14) + (1 << 18)):
        for size in (edge - 1, edge, edge + 1):
            for tail in ("a", "a", "b"):
                rows.append((n, "x" * (size - 1) + tail))
                n += 1
    rows += [(n, "y" * 3_000_000), (n + 1, "y" * 3_000_000), (n + 2, "y" * 2_999_999)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == exact_model(rows)


def test_exact_empty_and_kept_rows(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (3, "c"), (None, "d"), (None, "d")]
    d = docs(spark, rows)
    left = common.take_kept(d, exact_dedup.exact_dedup(d))
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(2, "a"), (3, "b"), (3, "c"), (None, "d")]


def shingle_counts(t):
    ws = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    ws = ws if len(ws) >= 5 or not ws else ws + [None] * (5 - len(ws))
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def near_model(rows, least=0.8):
    texts = sorted({t or "" for _, t in rows})
    bags, up = {t: shingle_counts(t) for t in texts}, {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if all_ and both / all_ >= least:
                up[top(a)] = top(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(top(t or ""), []).append(i)
    return sorted(((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids), key=str)


def near_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    rows, n = [(0, ""), (1, None), (2, "one two"), (3, "One, two!"), (4, "..."), (5, "a b c d e"), (6, "a b c d f")], 10
    for group in range(8):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, "x " * 3000), (n + 1, "x " * 2900), (n + 2, "x " * 1000), rows[8], (None, rows[9][1])]
    return rows


def test_near(spark):
    rows = near_rows()
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == near_model(rows)
    kept = Counter(r.class_id for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.class_id for r in got}


def test_near_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SPAN", 2)
    rows = near_rows(8)
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == near_model(rows)


def test_near_empty(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_signatures_are_unbiased():
    rng, got = random.Random(2), []
    for t in range(60):
        w = [f"w{t}x{rng.randrange(10**9)}" for _ in range(200)]
        v = [f"q{t}x{i}" if i % 33 == 5 else x for i, x in enumerate(w)]
        texts = [" ".join(w), " ".join(v), " ".join(w * 3 + v)]
        sig, _ = bagminhash.signatures(texts)
        bags = bagminhash.multisets(texts)
        got.append([(sig[a] == sig[b]).mean() - bagminhash.similarity(bags[a], bags[b]) for a, b in ((0, 1), (0, 2), (1, 2))])
    mean, error = np.mean(got, axis=0), np.std(got, axis=0) / np.sqrt(len(got))
    assert (np.abs(mean) < 4 * error + 1e-3).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 5000
    whole = bagminhash.shingles([text, "a b"])
    monkeypatch.setattr(bagminhash, "CHUNK", 1000)
    assert all((a == b).all() for a, b in zip(whole, bagminhash.shingles([text, "a b"]), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (200, 200)] + [(50, k) for k in range(60, 90)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100} | {k: 50 for k in [50, *range(60, 90)]}
