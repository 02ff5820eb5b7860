"""Each stage of the pipeline against a brute-force version on the rows that its predecessor kept."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402

from corpusloom.llm import common, sentencepiece_codec  # noqa: E402

from .test_dedup import exact_model, near_model  # noqa: E402
from .test_models import co_trained  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    kept.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, kept[-1], sf).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = stages[0].selectExpr("*", "xxhash64('sample', doc_id) as tie").collect()
    p = co_trained(rows, {r.doc_id: r.quality for r in labels.collect()}, rounds=3, each=0.05)
    got = {r.doc_id for r in stages[1].collect()}
    assert all((r.doc_id in got) == (q >= corpus_pipeline.LEAST_QUALITY) for r, q in zip(rows, p, strict=True) if abs(q - corpus_pipeline.LEAST_QUALITY) > 0.02)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - got) <= 0.02 * len(good)


def test_exact(stages):
    want = {(i, k) for i, _, _, k, _ in exact_model(pairs(stages[1])) if k}
    assert pairs(stages[2]) == sorted({r for r in pairs(stages[1]) if (r[0], True) in want})


def test_near(stages):
    keep = {c for _, c, _ in near_model(pairs(stages[2]))}
    assert pairs(stages[3]) == [r for r in pairs(stages[2]) if r[0] in keep]


def divided(given, kids):
    """The budget among children {name: (weight, cap)}, by the definition: whoever can't take a share gets all it can, and the others divide what is left."""
    out, open_ = {}, dict(kids)
    while open_:
        left, weight = given - sum(out.values()), sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * weight <= w * left}
        if not full:
            return out | {n: min(c, w * max(left, 0) // weight) for n, (w, c) in open_.items()}
        # one at a time, the one that is filled first
        n = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        out[n] = open_.pop(n)[1]
    return out


def mixture_model(rows):
    """(doc_id, text): epochs, from the definition."""
    size = lambda r: (len((r.text or "").encode()) + 3) // 4
    path = lambda r: (f"d{int(re.search(r'([0-9]{1,9})$', r.source or '0')[1] if re.search(r'[0-9]$', r.source or '') else 0) % 4}", r.lang or "", r.source or "")
    leaves = Counter()
    for r in rows:
        leaves[path(r)] += size(r)
    weights = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "en": 6, "de": 2}
    given = {(): int(sum(leaves.values()) * 0.8)}
    for depth in range(3):
        for above in {p[:depth] for p in leaves}:
            kids = {n: (1 if depth == 2 else weights.get(n, 1), sum(2 * t for p, t in leaves.items() if p[: depth + 1] == (*above, n))) for n in {p[depth] for p in leaves if p[:depth] == above}}
            given |= {(*above, n): b for n, b in divided(given[above], kids).items()}
    out = {}
    for leaf, tokens in leaves.items():
        whole = min(given[leaf] // tokens, 2) if tokens else 0
        rest, used = given[leaf] - whole * tokens, 0
        place = lambda r: hashlib.md5(f"17|{whole}|{r.doc_id}".encode()).hexdigest()  # noqa: E731, B023
        for r in sorted((r for r in rows if path(r) == leaf), key=place):
            used += size(r)
            out[r.doc_id, r.text] = whole + (rest > 0 and used <= rest)
    return out


def test_mixing(stages):
    want = {k: n for k, n in mixture_model(stages[3].collect()).items() if n}
    assert Counter(pairs(stages[4])) == want and sum(want.values()) < 2 * stages[3].count()


def test_encoding(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = stages[4].select("doc_id", "text").collect()
    want = sorted((r.doc_id, ids) for r, ids in zip(rows, sp.encode([r.text for r in rows]), strict=True))
    got = stages[5].collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want and all(r.exact for r in got)


def test_run(spark, sf, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in stages[5].collect())


def test_run_leaves_one_table(spark, sf):
    before = set(common._TABLES)
    corpus_pipeline.run(spark, sf)
    assert len(set(common._TABLES) - before) == 1


#: Names that operators use, or have used, for columns of their own.
TAKEN = "p_quality p_text p_meta _k_x mix_epochs mix_tokens mix_domain _whole _domain _copy _id _sha _text_sha row id own sha i h gone k0 keep0 t key uid tie y size n n_pieces ids exact col l0 xt z0 node comp kept domain `a.b` `c d`".split()
TAKEN = [*TAKEN[:-2], "`c d`"]


def awkward(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "src0", 5), (2, words, "en", "src0", 5), (3, words + " more", None, None, None), (4, None, "de", "src1", 0), (5, "", "de", "src1", 0), (6, "other " * 30_000, "en", "src2", 180_000), (6, "other " * 30_000, "en", "src2", 180_000), (None, "no id at all", "fr", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}="), F.coalesce(F.length("text"), F.lit(-1))).alias(c.strip("`")) for c in TAKEN], F.lit(None).cast("array<int>").alias("nothing"))


@pytest.mark.parametrize("k", range(5))
def test_stages_with_awkward_rows(spark, sf, k):
    docs, (_, stage) = awkward(spark), corpus_pipeline.STAGES[k]
    before = {str(r) for r in docs.collect()}
    out = stage(spark, docs, sf)
    got = out.collect()
    if k < 4:
        assert out.columns == docs.columns and {str(r) for r in got} <= before and got
    kept = Counter(r.doc_id for r in got)
    if k in (1, 2):
        assert kept[6] == 1 and kept[1] + kept[2] == 1 and kept[4] + kept[5] == 1 and kept[None] == 1
    if k == 1:
        assert kept[2] == kept[3] == 1 and kept[5] == 1
    if k == 2:
        assert kept[1] == 1 and kept[3] == 0
    if k == 4:
        assert len(got) == docs.count() and all(r.exact for r in got) and {r.n_pieces for r in got if r.doc_id in (4, 5)} == {0}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_kept_columns_of_any_name(spark):
    from corpusloom.llm import line_dedup, pii

    df = spark.createDataFrame([(1, "x@y.com", "u", 7)], "doc_id long, text string, ids string, n_email int")
    codec = sentencepiece_codec.encode(df, MODEL, ["ids", "doc_id"])
    assert codec.columns == ["ids", "doc_id", "_ids"] and codec.first().ids == "u"
    back = sentencepiece_codec.decode(codec, MODEL, ["ids"], "_ids").first()
    assert back.decoded == "x@y.com" and back.ids == "u"
    got = pii.pseudonymised(df, "k", keep=("text", "n_email")).first()
    assert got.text == "x@y.com" and got.n_email == 7 and got._n_email == 1 and got._text.endswith(".example")
    lines = line_dedup.line_dedup(df.selectExpr("'http://a.b' as url", "text as host", "doc_id as n_lines"), text=F.lit("a"), keep=("host", "n_lines")).first()
    assert (lines.host, lines.n_lines, lines._host, lines._n_lines) == ("x@y.com", 1, "a.b", 1)
