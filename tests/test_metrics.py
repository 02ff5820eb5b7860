import math
import random
import time

import pytest

from corpusloom.operators import concepts, discourse, lexical, lm, syntax
from corpusloom.operators.annotate import SCHEMA, RuleAnnotator, lemmatize_tokens, tokenize_text
from corpusloom.plans import runners

#: word, pos, dep, head: "the cat said that dogs run and birds sing ."
TREE = [("The", "DET", "det", 1), ("cat", "NOUN", "nsubj", 2), ("said", "VERB", "ROOT", 2), ("that", "SCONJ", "mark", 5), ("dogs", "NOUN", "nsubj", 5), ("run", "VERB", "ccomp", 2), ("and", "CCONJ", "cc", 5), ("birds", "NOUN", "dobj", 8), ("sing", "VERB", "conj", 5), (".", "PUNCT", "punct", 2)]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, 0, i, w, w.lower(), p, d, h, w.isalpha(), p == "PUNCT", False) for i, (w, p, d, h) in enumerate(TREE)]
    rows += [(1, 1, 10, "!", "!", "PUNCT", "ROOT", 10, False, True, False)]
    return spark.createDataFrame(rows, SCHEMA)


def test_clauses(tree):
    a, b = syntax.clause_metrics(tree).orderBy("sent_id").collect()
    assert (a.main, a.subordinate, a.coordinate, a.subordination_ratio, a.coordination_ratio) == (1, 1, 1, 1.0, 1.0)
    assert (b.main, b.subordinate, b.subordination_ratio) == (1, 0, 0.0)


def test_depth(tree):
    a, b = syntax.embedding_depth(tree).orderBy("sent_id").collect()
    d = [2, 1, 0, 2, 2, 1, 2, 3, 2, 1]
    assert (a.max_depth, a.mean_depth, a.median_depth) == (3, sum(d) / 10, 2.0) and math.isclose(a.depth_skew, sum(d) / 10 - 2)
    assert (b.max_depth, b.mean_depth) == (0, 0.0)


def test_deep_chain(spark):
    n = 300
    rows = [(1, 0, i, "w", "w", "NOUN", "ROOT" if i == 0 else "dep", max(i - 1, 0), True, False, False) for i in range(n)]
    got = syntax.embedding_depth(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.max_depth, got.mean_depth) == (n - 1, (n - 1) / 2)


def test_dependencies(tree):
    a, b = syntax.dependency_complexity(tree).orderBy("sent_id").collect()
    arcs = [abs(i - h) for i, (_, _, _, h) in enumerate(TREE) if i != h]
    assert (a.main_clause, a.subordinate_clause, a.coordinate_clause, a.max_dependents) == (3.0, 4.0, 1.0, 4) and a.mean_dependency_distance == sum(arcs) / len(arcs)
    assert (b.main_clause, b.max_dependents, b.mean_dependency_distance) == (0.0, 0, 0.0)


def test_roles(tree):
    a, b = syntax.semantic_roles(tree).orderBy("sent_id").collect()
    assert [tuple(r) for r in a.semantic_roles] == [("nsubj", "cat", "said"), ("nsubj", "dogs", "run"), ("dobj", "birds", "sing")] and a.role_count == 3
    assert b.semantic_roles == [] and b.role_count == 0


def test_clause_structures(tree):
    got = {r.predicate: (r.clause_level, r.agent, r.patient, r.clause_tokens) for r in syntax.clauses(tree).collect()}
    words = [w for w, *_ in TREE]
    assert got["said"][:3] == ("main", "The cat", None) and got["said"][3] == words
    assert got["run"] == ("subordinate", "dogs", None, subtree(5)) and got["sing"] == ("coordinate", None, "birds", subtree(8))
    a, b = syntax.semantic_structures(tree).orderBy("sent_id").collect()
    assert (a.num_clauses, a.num_agents, a.num_patients) == (3, 2, 1) and [c.predicate for c in a.clauses] == ["said", "run", "sing"] and (b.clauses, b.num_clauses) == ([], 0)


def subtree(top):
    heads = [h for *_, h in TREE]

    def under(i):
        return i == top or heads[i] != i and under(heads[i])

    return [w for i, (w, *_) in enumerate(TREE) if under(i)]


def clauses_model(rows):
    """By the definition, from one sentence's (text, lemma, pos, dep, head)."""
    kids = {i: [k for k, r in enumerate(rows) if r[4] == i and k != i] for i in range(len(rows))}

    def tree(i):
        return sorted([i, *(x for k in kids[i] for x in tree(k))])

    out = []
    for i, (_, lemma, pos, dep, _) in enumerate(rows):
        level = "main" if dep == "ROOT" else "subordinate" if any(x in dep for x in ("advcl", "ccomp", "xcomp")) else "coordinate" if dep == "conj" else None
        if pos == "VERB" and level:
            said = lambda what: "; ".join(" ".join(rows[x][0] for x in tree(k)) for k in kids[i] if what in rows[k][3]) or None  # noqa: E731, B023
            out.append((i, level, lemma, said("subj"), said("obj"), [rows[x][0] for x in tree(i)]))
    return out


def test_clauses_of_random_trees(spark):
    """Trees that cross, several subjects of a verb, nested clauses, verbs that are auxiliaries."""
    rng, rows, want = random.Random(5), [], {}
    for s in range(30):
        n = rng.randrange(1, 25)
        order = rng.sample(range(n), n)
        heads = {order[0]: order[0]} | {order[k]: order[rng.randrange(k)] for k in range(1, n)}
        sent = [(f"w{i}", f"l{i}", rng.choice(["VERB", "VERB", "AUX", "NOUN"]), "ROOT" if heads[i] == i else rng.choice(["nsubj", "nsubjpass", "csubj", "dobj", "pobj", "conj", "advcl", "ccomp", "det"]), heads[i]) for i in range(n)]
        rows += [(1, s, 100 * s + i, t, lemma, p, d, 100 * s + h, True, False, False) for i, (t, lemma, p, d, h) in enumerate(sent)]
        want |= {(s, 100 * s + i): tuple(r) for i, *r in clauses_model(sent)}
    tokens = spark.createDataFrame(rows, SCHEMA)
    got = {(r.sent_id, r.tok_id): (r.clause_level, r.predicate, r.agent, r.patient, r.clause_tokens) for r in syntax.clauses(tokens).collect()}
    assert got == want and len(want) > 50
    counts = {r.sent_id: (r.num_clauses, r.num_agents, r.num_patients) for r in syntax.clause_counts(tokens).collect()}
    for s in range(30):
        own = [v for (k, _), v in want.items() if k == s]
        assert counts[s] == (len(own), sum(v[2] is not None for v in own), sum(v[3] is not None for v in own))


def test_very_long_sentence(spark):
    """Twenty thousand tokens without an end mark, in seconds."""
    text = " ".join(["the dogs walked to the old houses and birds jumped over it"] * 1700)
    tokens = RuleAnnotator().tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    began = time.time()
    assert tokens.count() > 20_000
    annotated, began = time.time() - began, time.time()
    got = syntax.clauses(tokens).collect()
    assert len(got) == 3400 and time.time() - began < 60 + 10 * annotated
    assert syntax.semantic_structures(tokens).first().num_clauses == 3400


def test_density_and_cohesion(tree):
    a, b = lexical.lexical_density(tree).orderBy("sent_id").collect()
    assert (a.token_count, a.content_count, a.lexical_density) == (9, 6, 6 / 9) and b.lexical_density is None
    w = runners.cohesion_windows(tree).collect()
    assert w[0].cohesion_overlap is None


def test_information_content(tree, spark):
    freqs = spark.createDataFrame([("cat", 4), ("dogs", 1), ("zero", 0)], "word string, freq long")
    a, b = lexical.information_content(tree, freqs).orderBy("sent_id").collect()
    assert math.isclose(a.information_content, -math.log(4) / 2) and a.ic_count == 2 and a.ic_values == [-math.log(4), 0.0] and b.information_content is None and b.ic_values == []


def test_mattr(spark):
    texts = {0: [], 1: ["a"] * 49, 2: ["a", "b"] * 25, 3: ["a", "b"] * 25 + ["c"], 4: [f"w{'x' * (k % 60)}" for k in range(130)]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.mattr for r in lexical.mattr(df).collect()}
    for i, w in texts.items():
        want = 0.0 if not w else len(set(w)) / len(w) if len(w) < 50 else round(sum(len(set(w[k : k + 50])) / 50 for k in range(len(w) - 49)) / (len(w) - 49), 3)
        assert math.isclose(got[i], want, abs_tol=1e-12), i


def test_rule_annotator(spark):
    df = spark.createDataFrame([(1, "The cat walked to it. And?"), (2, ""), (3, None)], "doc_id long, text string")
    rows = RuleAnnotator().tokens(df).orderBy("doc_id", "tok_id").collect()
    assert [(r.sent_id, r.text, r.pos, r.dep, r.head_id) for r in rows] == [
        (0, "The", "DET", "det", 1), (0, "cat", "NOUN", "nsubj", 2), (0, "walked", "VERB", "ROOT", 2), (0, "to", "ADP", "prep", 2), (0, "it", "PRON", "pobj", 3), (0, ".", "PUNCT", "punct", 2), (1, "And", "CCONJ", "ROOT", 6), (1, "?", "PUNCT", "punct", 6),
    ]
    t = tokenize_text(df)
    assert t.first().tokens[:3] == ["The", "cat", "walked"]
    assert lemmatize_tokens(t).first().lemmas[2] == "walk"


def test_top_words(spark):
    df = spark.createDataFrame([(1, "b a b a c end. end. c c"), (2, "")], "doc_id long, text string")
    assert [(r.word, r.freq, r["rank"]) for r in lexical.top_words(df, 2).orderBy("rank").collect()] == [("c", 3, 1), ("b", 2, 2)]


def test_phrases(spark):
    df = spark.createDataFrame([(1, "the old house is by the river. An old house can see the 12 boats of it.")], "doc_id long, text string")
    got = [r.phrase for r in concepts.noun_phrases(RuleAnnotator().tokens(df)).orderBy("phrase_idx").collect()]
    assert got[0] == "old house" and "river" in got and len(got) == len(set(got))
    p = spark.createDataFrame([(1, i, w) for i, w in enumerate("b a a c b d".split())], "doc_id long, phrase_idx long, phrase string")
    assert [r.phrase for r in concepts.top_phrases(p, 2).orderBy("phrase_idx").collect()] == ["b", "a", "a", "b"]


def test_phrase_filters(spark):
    df = spark.createDataFrame([(w,) for w in ("'s", "cat’s", "--", "12", "old house")], "p string")
    assert [r.p for r in df.where(concepts.kept_phrase(df.p)).collect()] == ["cat’s", "old house"]


def test_chunk_scores(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id long, text string")
    got = lm.chunk_log_probs(df, lm.UnigramScorer(df), 2).orderBy("chunk_id").collect()
    p = {"a": math.log(3 / 5), "b": math.log(2 / 5)}
    assert [round(r.avg_log_prob, 9) for r in got] == [round((p["a"] + p["b"]) / 2, 9), round(p["a"], 9)]
    doc = lm.document_log_probs(lm.chunk_log_probs(df, lm.UnigramScorer(df), 2)).first()
    assert doc.num_tokens == 3 and math.isclose(doc.avg_log_prob, ((p["a"] + p["b"]) / 2 + p["a"]) / 2)
    whole = {r.doc_id: r for r in runners.whole_text_metrics(df).collect()}
    assert whole[2].avg_log_prob is None and whole[2].num_tokens == 0 and whole[1].top_words[0].word == "a"


def test_discourse(spark):
    df = spark.createDataFrame([(1, "We came because they left"), (2, "No"), (3, None)], "doc_id long, text string")
    a, b, c = discourse.parse(df).orderBy("doc_id").collect()
    assert (a.arg1_span, a.connective, a.arg2_span, a.explicit) == ("We came", "because", "they left", "true")
    assert b.explicit == c.explicit == "false" and a.level1 == "Expansion"


def test_discourse_reads_the_whole_text(spark):
    text = "word " * 600 + "but " + "more " * 600
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = discourse.parse(docs).collect()
    assert (r.connective, r.explicit, r.arg1_span, r.arg2_span) == ("but", "true", ("word " * 600).strip(), ("more " * 600).strip())
    (r,) = discourse.parse(docs, limit=512).collect()
    assert (r.explicit, r.arg1_span) == ("false", "")


def test_cohesion_ignores_case(spark):
    rows = [(1, s, s, w, w, "PROPN", "ROOT", s, True, False, False) for s, w in enumerate(["Paris", "paris", "rome"])]
    got = [(r.cohesion_overlap, r.content_words) for r in lexical.cohesion(spark.createDataFrame(rows, SCHEMA)).orderBy("sent_id").collect()]
    assert got == [(None, ["paris"]), (1, ["paris"]), (0, ["rome"])]


def test_words_meet_frequencies_once_a_sentence(spark):
    df = spark.createDataFrame([(1, "the cat the dog the. !!! The end")], "doc_id long, text string")
    got = {(r.sent_id, r.word): (sorted(r.tok_ids), r.content) for r in lexical.sentence_words(RuleAnnotator().tokens(df)).collect()}
    assert got[0, "the"] == ([0, 2, 4], 0) and got[0, "cat"] == ([1], 1) and {k[0] for k in got} == {0, 1, 2}
    assert [v for k, v in got.items() if k[0] == 1] == [([], 0)]


def test_agent_windows_hold_their_sentences(spark):
    df = spark.createDataFrame([(1, "Dogs walked it. No. Cats jumped. End.")], "doc_id long, text string")
    got = runners.agent_windows(RuleAnnotator().tokens(df), docs=df).orderBy("start_sentence").collect()
    assert [(r.start_sentence, r.total_clauses, r.total_agents, r.total_patients) for r in got] == [(0, 2, 2, 1), (1, 1, 1, 0)]
    assert [s.strip() for s in got[0].sentences] == ["Dogs walked it.", "No.", "Cats jumped."]


def test_window_metrics_annotate_twice_at_most(spark):
    df = spark.createDataFrame([(1, "Dogs walked it. No. Cats jumped. End.")], "doc_id long, text string")
    plan = runners.window_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    # the second pass, for the overall mean of the surprisal, has only the words
    assert plan.count("posexplode(regexp_extract_all(") <= 2 and plan.count("advmod") == 1


def test_logit_scorer(spark):
    """The log-softmax at the token's own position, and shifted by one."""
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")

    def load():
        return lambda tokens: ([0 if t == "a" else 1 for t in tokens], [[1.0 + k, 0.0] for k in range(len(tokens))])

    p = lambda k, i: (1 + k if i == 0 else 0) - math.log(math.exp(1 + k) + 1)
    for shifted, want in ((False, {1: (p(0, 0) + p(1, 1) + p(2, 0)) / 3, 2: p(0, 1)}), (True, {1: (p(0, 1) + p(1, 0)) / 2, 2: None})):
        got = {r.doc_id: r.avg_log_prob for r in lm.chunk_log_probs(df, lm.LogitScorer(load, shifted)).collect()}
        assert got.keys() == want.keys() and all(got[k] == w or math.isclose(got[k], w) for k, w in want.items())


def test_parser_of_ones_own(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    got = discourse.parse_with(df, lambda: lambda t: [{"level1": "Contingency", "connective": t}] * len(t)).collect()
    assert [(r.doc_id, r.level1, r.connective, r.direction) for r in got] == [(1, "Contingency", "x", None)] and got[0].__fields__ == discourse.parse(df).columns


def test_stop_words_are_an_argument(spark):
    df = spark.createDataFrame([(1, "the old house")], "doc_id long, text string")
    t = RuleAnnotator().tokens(df)
    assert concepts.noun_phrases(t).first().phrase == "old house" and concepts.noun_phrases(t, stop_words=("old",)).first().phrase == "the house"
