"""The registered queries of the engine's own operators: each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import clean_text, remove_patterns, trim_to_end, trim_to_start
from ..operators import concepts, discourse, graph, lexical, lm, local, similar
from ..operators.annotate import RuleAnnotator, lemmatize_tokens, sentences, tokenize_text
from ..operators.counted import Counted
from ..operators.windows import chunks
from ..sources.books import HEADING, PAGE_NUMBER, ROMAN_NUMERAL, URL
from ..sources.files import todo
from . import runners as r

#: Edges of the registered networks: with 0.3 few labels have a connected part.
LOOSE = 0.1


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


def clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("text"))


def marker_trim(spark, sf_dir):
    text = trim_to_end(trim_to_start(F.col("text"), F.lit("the ")), F.lit("and"))
    return _docs(spark, sf_dir).select("doc_id", clean_text(text).alias("text"))


def boilerplate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean_text(remove_patterns(F.col("text"), [PAGE_NUMBER, HEADING, URL])).alias("text"))


def roman_numerals(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean_text(remove_patterns(F.col("text"), [ROMAN_NUMERAL])).alias("text"))


def word_freq(spark, sf_dir):
    return lexical.corpus_frequencies(_docs(spark, sf_dir), min_freq=2)


def top_words(spark, sf_dir):
    return lexical.top_words(_docs(spark, sf_dir))


def sentence_split(spark, sf_dir):
    return sentences(_docs(spark, sf_dir))


def tokens(spark, sf_dir):
    return RuleAnnotator().tokens(_docs(spark, sf_dir))


def lexical_density(spark, sf_dir):
    return local.lexical_density(_docs(spark, sf_dir))


def lexical_density_w3(spark, sf_dir):
    return local.density_windows(_docs(spark, sf_dir))


def information_content_w3(spark, sf_dir):
    return Counted(_docs(spark, sf_dir)).information_windows()


def cohesion_w3(spark, sf_dir):
    return local.cohesion_windows(_docs(spark, sf_dir))


def clause_metrics(spark, sf_dir):
    return local.clause_metrics(_docs(spark, sf_dir))


def clause_metrics_w3(spark, sf_dir):
    return local.clause_windows(_docs(spark, sf_dir))


def depth_w3(spark, sf_dir):
    return local.depth_windows(_docs(spark, sf_dir))


def dependency_w3(spark, sf_dir):
    return local.dependency_windows(_docs(spark, sf_dir))


def semantic_roles(spark, sf_dir):
    return local.semantic_roles(_docs(spark, sf_dir))


def agent_patient(spark, sf_dir):
    return local.clauses(_docs(spark, sf_dir))


def agent_windows(spark, sf_dir):
    return local.agent_windows(_docs(spark, sf_dir))


def clause_structures(spark, sf_dir):
    return local.clause_structures(_docs(spark, sf_dir))


def information_content(spark, sf_dir):
    return _rounded(Counted(_docs(spark, sf_dir)).information_content(), "information_content", places=9)


def lemmas(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return lemmatize_tokens(tokenize_text(d)).select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


def text_tokens(spark, sf_dir):
    return tokenize_text(_docs(spark, sf_dir)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def sliding_density(spark, sf_dir):
    return local.density_sliding(_docs(spark, sf_dir))


def mattr_50(spark, sf_dir):
    return lexical.mattr(_docs(spark, sf_dir))


def avg_word_freq(spark, sf_dir):
    return Counted(_docs(spark, sf_dir)).average_word_frequency()


def surprisal(spark, sf_dir):
    return Counted(_docs(spark, sf_dir)).surprisal()


def chunks_2048(spark, sf_dir):
    return chunks(lm.whitespace_tokens(_docs(spark, sf_dir))).drop("chunk")


def chunks_overlap(spark, sf_dir):
    return chunks(lm.whitespace_tokens(_docs(spark, sf_dir)), 512, 64).drop("chunk")


def chunk_scores(spark, sf_dir):
    return _rounded(Counted(_docs(spark, sf_dir)).chunk_log_probs(), "avg_log_prob")


def doc_logprob(spark, sf_dir):
    return _rounded(Counted(_docs(spark, sf_dir)).document_log_probs(), "avg_log_prob")


def whole_text(spark, sf_dir):
    return _rounded(Counted(_docs(spark, sf_dir)).whole_text(), "avg_log_prob")


def turn_overlap(spark, sf_dir):
    return lexical.turn_overlap(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def clause_series(spark, sf_dir):
    return r.series(local.clause_windows(_docs(spark, sf_dir)), "subordinate", "coordinate")


def depth_series(spark, sf_dir):
    return r.series(local.depth_windows(_docs(spark, sf_dir)), *r.DEPTH)


def dependency_series(spark, sf_dir):
    return r.series(local.dependency_windows(_docs(spark, sf_dir)), *r.DEPENDENCY)


def syntax_analysis(spark, sf_dir):
    return r.syntax_analysis(_docs(spark, sf_dir))


def window_metrics(spark, sf_dir):
    return r.window_metrics(_docs(spark, sf_dir))


def phrases(spark, sf_dir):
    return local.noun_phrases(_docs(spark, sf_dir), concepts.STOP_WORDS)


def top_n_phrases(spark, sf_dir):
    return local.noun_phrases(_docs(spark, sf_dir), concepts.STOP_WORDS, 100)


def sim_edges(spark, sf_dir):
    return _rounded(graph.similarity_edges(_nodes(spark, sf_dir)), "weight")


def degree(spark, sf_dir):
    return _rounded(similar.degree(_nodes(spark, sf_dir), LOOSE), "degree")


def closeness(spark, sf_dir):
    return _rounded(similar.paths(_nodes(spark, sf_dir), LOOSE, between=False).select("doc_id", "node_id", "closeness"), "closeness")


def betweenness(spark, sf_dir):
    return _rounded(similar.paths(_nodes(spark, sf_dir), LOOSE).select("doc_id", "node_id", "betweenness"), "betweenness")


def centralities(spark, sf_dir):
    names = ("degree", "betweenness", "closeness", "eigenvector", "pagerank")
    return _rounded(similar.centralities(_nodes(spark, sf_dir), LOOSE), *names)


def communities(spark, sf_dir):
    return similar.communities(_nodes(spark, sf_dir), LOOSE)


def clusters(spark, sf_dir):
    return concepts.cluster_embeddings(_nodes(spark, sf_dir).withColumnRenamed("node_id", "idx"))


def node_style(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return _rounded(r.network(n, LOOSE)["node_style"].select("doc_id", "node_id", "size", "border", "colour"), "size", "border")


def edge_style(spark, sf_dir):
    return _rounded(r.network(_nodes(spark, sf_dir), LOOSE)["edge_style"], "width", "alpha")


def concept_network(spark, sf_dir):
    return local.concept_edges(_docs(spark, sf_dir), concepts.STOP_WORDS, 0.3)


def discourse_baseline(spark, sf_dir):
    return discourse.parse(_docs(spark, sf_dir))


def incremental_todo(spark, sf_dir):
    return todo(_docs(spark, sf_dir).select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rounding(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount") / 7).alias("x"))
    return x.select("l_orderkey", "l_linenumber", exact_round("x").alias("two"), exact_round("x", 3).alias("three"))


def queries() -> dict:
    found = (
        top_words, clean, marker_trim, boilerplate, roman_numerals, word_freq, sentence_split, tokens, lexical_density, lexical_density_w3, information_content_w3, cohesion_w3, clause_metrics,
        clause_metrics_w3, depth_w3, dependency_w3, semantic_roles, agent_patient, agent_windows, clause_structures, information_content, lemmas, text_tokens, sliding_density, mattr_50, avg_word_freq, surprisal, chunks_2048, chunks_overlap, chunk_scores,
        doc_logprob, whole_text, turn_overlap, clause_series, depth_series, dependency_series, syntax_analysis, window_metrics, phrases, top_n_phrases, sim_edges, degree, closeness,
        betweenness, centralities, communities, clusters, node_style, edge_style, concept_network, discourse_baseline, incremental_todo, rounding,
    )
    return {f.__name__: f for f in found}
