import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import concepts, counted, graph, lexical, lm, local, syntax
from corpusloom.operators.annotate import RuleAnnotator, sentences, tokenize_text, with_sentences
from corpusloom.plans import runners

PIECES = ["the", "cats", "Dogs", "walked", "said", "that", "to", "running", "and", "because", "quickly", "useful", "of", "it", "will", "42", "x9", ".", "!?", "...", ",", "é", "ÀS", "ΣΑΣ", "ß", " ", "́", "𝔘n", "١٢", "😀", "'s", "-", "\n", "\t", "  ", ". ", "ing", "ed", "ss", "bus", "ABLE"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = ["", None, " ", ". .", "?", " \n\t", "a", "...a", "no mark at all", " ."] + ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 90))) for _ in range(70)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def tokens(docs):
    return RuleAnnotator().tokens(docs).cache()


def same(got, want):
    want = want.select(*got.columns)
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    a, b = (sorted(map(repr, df.collect())) for df in (got, want))
    assert a == b and a


def test_tokens_are_those_of_the_expressions(docs, tokens):
    found = sentences(docs).select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), 0)).alias("k", "text"))
    want = [(r.doc_id, r.sent_id, r.text) for r in found.orderBy("doc_id", "sent_id", "k").collect()]
    rows = tokens.orderBy("doc_id", "tok_id").collect()
    assert [(r.doc_id, r.sent_id, r.text) for r in rows] == want
    assert all(r.is_alpha == (r.text.isalpha()) for r in rows if r.text.isascii())
    own = {}
    for r in rows:
        assert r.tok_id == own.get(r.doc_id, -1) + 1
        own[r.doc_id] = r.tok_id


def test_metrics_are_those_of_the_tokens_table(docs, tokens):
    same(local.clause_metrics(docs), syntax.clause_metrics(tokens))
    same(local.lexical_density(docs), lexical.lexical_density(tokens))
    same(local.syntax_windows(docs), runners.syntax_windows(tokens))
    same(local.depth_windows(docs, 2), runners.depth_windows(tokens, 2))
    same(local.dependency_windows(docs), runners.dependency_windows(tokens))
    same(local.density_windows(docs), runners.density_windows(tokens))
    same(local.cohesion_windows(docs), runners.cohesion_windows(tokens))
    same(local.density_sliding(docs), runners.density_sliding(tokens))


def test_structures_are_those_of_the_tokens_table(docs, tokens):
    same(local.clauses(docs), syntax.clauses(tokens).withColumn("clause_tokens", F.array_join("clause_tokens", " ")))
    same(local.agent_windows(docs), runners.agent_windows(tokens, docs=docs).withColumn("sentences", F.array_join("sentences", "|")))
    x = syntax.semantic_structures(tokens)
    same(local.clause_structures(docs), x.select("doc_id", "sent_id", F.array_join(F.transform("clauses", lambda c: F.concat_ws(":", c["clause_level"], c["predicate"])), ",").alias("clauses"), *[F.col(c).cast("long").alias(c) for c in runners.ROLES]))
    x = with_sentences(syntax.semantic_roles(tokens), docs)
    same(local.semantic_roles(docs), x.select("doc_id", "sent_id", "sentence_text", F.array_join(F.transform("semantic_roles", lambda r: F.concat_ws(":", r["role"], r["text"], r["head"])), ",").alias("roles"), F.col("role_count").cast("long").alias("role_count")))
    p = concepts.noun_phrases(tokens)
    same(local.noun_phrases(docs, concepts.STOP_WORDS), p)
    same(local.noun_phrases(docs, concepts.STOP_WORDS, 3), concepts.top_phrases(p, 3))


def test_nothing_is_shuffled(docs):
    """Before, tokens were sorted within their documents for every window, and carried through groupings."""
    for df in (RuleAnnotator().tokens(docs), local.syntax_windows(docs), local.clauses(docs), local.clause_structures(docs), local.agent_windows(docs), local.semantic_roles(docs), local.noun_phrases(docs, ()), local.cohesion_windows(docs), tokenize_text(docs), runners.syntax_analysis(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_blocks_split_anywhere(docs):
    """A result doesn't hang on which documents share a block."""
    from corpusloom.operators import blocks

    texts = [r.text or "" for r in docs.collect()]
    whole = blocks.Block(texts)
    apart = [blocks.Block([t]) for t in texts]
    for f in (lambda b: b.clauses(), lambda b: b.depth(), lambda b: b.dependency(), lambda b: b.roles()):
        for c, x in f(whole).items():
            assert x.tolist() == [v for b in apart for v in f(b)[c].tolist()], c


@pytest.mark.parametrize("common", [5, 10_000])
def test_counted_metrics_are_those_of_the_tokens_table(docs, tokens, monkeypatch, common):
    """With the counts of a few words in every task, and the others from a join; and with all of them in every task."""
    monkeypatch.setattr(counted, "COMMON", common)
    c, freqs, scorer = counted.Counted(docs), lexical.corpus_frequencies(docs).cache(), lm.UnigramScorer(docs)
    assert c.all_common == (common > 5)
    same(c.average_word_frequency(), lexical.average_word_frequency(tokens, freqs))
    same(c.surprisal(), lm.surprisal(tokens, scorer))
    same(c.information_windows(), runners.information_windows(tokens, freqs))
    close(c.chunk_log_probs(7), lm.chunk_log_probs(docs, scorer, 7), "chunk_id", "avg_log_prob")
    close(c.document_log_probs(7), lm.document_log_probs(lm.chunk_log_probs(docs, scorer, 7)), "doc_id", "avg_log_prob")
    plan = c.window_metrics()._jdf.queryExecution().executedPlan().toString()
    # the texts are shuffled once if there are rare words, and tokens never
    assert "posexplode" not in plan and "Window" not in plan and plan.count("Exchange") <= (0 if c.all_common else 8)


def close(got, want, key, value):
    a, b = ({(r.doc_id, r[key]): r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and a
    for k in a:
        assert abs(a[k].pop(value) - b[k].pop(value)) < 1e-9 and a[k] == b[k]


def test_window_metrics_are_those_of_an_annotator(docs):
    same(runners.window_metrics(docs), runners.window_metrics(docs, annotator=RuleAnnotator()))


def test_concept_networks_hold_all_phrases(spark, monkeypatch):
    """Before, the network had a document's first 100 phrases."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(3, 9))) + "x"
    docs = spark.createDataFrame([(1, " of ".join(word() + " " + word() for _ in range(180))), (2, "the old house"), (3, None), (4, "old houses of old horses of hours")], "doc_id long, text string")
    monkeypatch.setattr(local, "MANY", 50)
    got = {(r.doc_id, r.src, r.dst): r.weight for r in local.concept_edges(docs, concepts.STOP_WORDS, 0.3).collect()}
    nodes = runners.network_nodes(docs)
    assert nodes.where("doc_id = 1").count() > 150 and max(k[2] for k in got) > 150
    want = {(r.doc_id, r.src, r.dst): r.weight for r in graph.similarity_edges(nodes, 0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and {k[0] for k in got} == {1, 4}
