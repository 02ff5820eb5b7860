"""Composite plans: preprocessing, whole-text metrics, syntax and window metrics, concept networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import clean_text, midpoint, min_max, trim_to_end, trim_to_start
from ..operators import concepts, graph, lexical, lm, local, similar, syntax
from ..operators.annotate import Annotator, with_sentences
from ..operators.counted import Counted
from ..operators.local import CLAUSE, DEPENDENCY, DEPTH
from ..operators.windows import sliding, tumbling
from ..sources import files

#: Configured books that are broadcast at most; more meet the texts in a shuffle join.
FEW_BOOKS = 100_000


def preprocess(texts: DataFrame, config: DataFrame, *keep: str) -> DataFrame:
    """(*keep, name, text): of texts (name, text) with a row in config (book, start_marker, end_marker, patterns), trimmed to the markers, without the patterns, and with clean white space. Each row's patterns are its own: they are applied in order by a fold."""
    books = config.select("book", "start_marker", "end_marker", "patterns")
    books = F.broadcast(books) if books.limit(FEW_BOOKS + 1).count() <= FEW_BOOKS else books
    x = texts.join(books, F.lower("name") == F.lower("book"))
    text = F.when(F.col("start_marker").isNotNull(), trim_to_start(F.col("text"), F.col("start_marker"))).otherwise(F.col("text"))
    x = x.withColumn("text", text)
    x = x.withColumn("text", F.when(F.col("end_marker").isNotNull(), trim_to_end(F.col("text"), F.col("end_marker"))).otherwise(F.col("text")))
    folded = F.aggregate(F.coalesce("patterns", F.array().cast("array<string>")), F.col("text"), lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?imu)"), p), F.lit(" ")))
    return x.select(*keep, "name", clean_text(folded).alias("text"))


def preprocess_pdfs(spark: SparkSession, folder: str, config: DataFrame, load=files.pdf_reader, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """From the PDF files of a folder's genres to cleaned texts.

    config (book, pages, start_marker, end_marker, patterns) names the files that are wanted; load() makes the reader of a file's
    pages; done (name) has been cleaned before. texts (genre, name, text); skipped (genre, name): files without a row in config;
    missing_pages (name, page_no): pages that were asked for and don't exist.
    """
    pdfs = files.list_pdfs(spark, folder)
    pdfs = pdfs if done is None else files.todo(pdfs, done, "name")
    books = config.withColumn("book", F.lower("book"))
    wanted = books.select(F.col("book").alias("name"), "pages")
    # only the files of configured books are read
    pages = files.read_pdf_pages(pdfs.join(books.select(F.col("book").alias("name")), "name", "left_semi"), load)
    texts = files.pages_to_text(pages, wanted)
    return {"texts": preprocess(texts, books, "genre"), "skipped": pdfs.select("genre", "name").join(wanted.select("name"), "name", "left_anti").select("genre", "name"), "missing_pages": files.missing_pages(pages, wanted).select("name", "page_no")}


def whole_text_metrics(docs: DataFrame, model_name: str = "unigram", scorer: lm.LogProbScorer | None = None) -> DataFrame:
    """(doc_id, model, avg_log_prob, num_tokens, top_words, chunks) of every document; a text without tokens has null and empty lists."""
    scored = lm.chunk_log_probs(docs, scorer or lm.UnigramScorer(docs))
    fields = F.struct("chunk_id", "start_token", "end_token", "avg_log_prob", "num_tokens", "text_snippet")
    per = scored.groupBy("doc_id").agg(F.avg("avg_log_prob").alias("avg_log_prob"), F.sum("num_tokens").alias("num_tokens"), F.array_sort(F.collect_list(fields)).alias("chunks"))
    top = lexical.top_words(docs, 50, 2).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "freq"))), lambda r: F.struct(r["word"].alias("word"), r["freq"].alias("freq"))).alias("top_words"))
    return docs.select("doc_id").join(per, "doc_id", "left").join(top, "doc_id", "left").select("doc_id", F.lit(model_name).alias("model"), "avg_log_prob", F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"), "top_words", "chunks")




def clause_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(syntax.clause_metrics(tokens), size, CLAUSE)


def depth_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(syntax.embedding_depth(tokens), size, DEPTH)


def dependency_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(syntax.dependency_complexity(tokens), size, DEPENDENCY)


def syntax_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(syntax.sentence_syntax(tokens), size, [*CLAUSE, *DEPTH, *DEPENDENCY])


def density_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(lexical.lexical_density(tokens), size, ["token_count", "content_count"], nullable=["lexical_density"])


def information_windows(tokens: DataFrame, freqs: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(lexical.information_content(tokens, freqs), size, [], firsts=["ic_count"], nullable=["information_content"])


def cohesion_windows(tokens: DataFrame, size: int = 3) -> DataFrame:
    return tumbling(lexical.cohesion(tokens), size, [], nullable=["cohesion_overlap"])


def density_sliding(tokens: DataFrame, size: int = 3) -> DataFrame:
    return sliding(lexical.lexical_density(tokens), size, ["token_count", "content_count", "lexical_density"])


ROLES = ["num_clauses", "num_agents", "num_patients"]
TOTALS = ["total_clauses", "total_agents", "total_patients"]


def _totals(rows: DataFrame, size: int, *more) -> DataFrame:
    """rows (doc_id, sent_id, *ROLES, ...) with the sums over the window that begins at each sentence, n, its sentences, and end_sentence."""
    frame = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(0, size - 1)
    sums = {t: F.sum(c).over(frame) for c, t in zip(ROLES, TOTALS, strict=True)}
    return rows.withColumns({"n": F.count(F.lit(1)).over(frame), "last_sentence": F.max("sent_id").over(frame)} | sums | {c: F.collect_list(c).over(frame) for c in more})


def agent_windows(tokens: DataFrame, size: int = 3, docs: DataFrame | None = None) -> DataFrame:
    """Sums of clauses, of those with an agent and of those with a patient in every full window, a sentence apart; with docs, also the window's sentences."""
    rows, more = syntax.clause_counts(tokens), ()
    if docs is not None:
        rows, more = with_sentences(rows, docs).withColumnRenamed("sentence_text", "sentences"), ("sentences",)
    x = _totals(rows, size, *more).where(F.col("n") == size)
    return x.select("doc_id", F.col("sent_id").cast("long").alias("start_sentence"), F.col("last_sentence").cast("long").alias("end_sentence"), *TOTALS, *more)


def series(windows: DataFrame, *values: str) -> DataFrame:
    """A plot's data: the middle sentence of each window, and the values."""
    return windows.select("doc_id", midpoint(F.col("start_sentence"), F.col("end_sentence")).alias("midpoint"), *values)


def syntax_analysis(docs: DataFrame, size: int = 3, annotator: Annotator | None = None) -> DataFrame:
    """Clause, depth and dependency windows side by side, in one pass over the tokens."""
    return local.syntax_windows(docs, size) if annotator is None else syntax_windows(annotator.tokens(docs), size)


def sentence_metrics(tokens: DataFrame, freqs: DataFrame, scorer: lm.UnigramScorer) -> DataFrame:
    """Every metric of each sentence, in one pass over the tokens: one grouping by sentence, then the distinct words meet both tables of frequencies in one join and come back together, the first of a sentence carrying what is known of it."""
    word = F.struct(F.lower("text").alias("word"), "tok_id", F.col("pos").isin(*lexical.CONTENT).alias("content"))
    lemmas = F.array_sort(F.collect_set(F.when(F.col("is_alpha"), F.lower("lemma")))).alias("content_words")
    density = [F.count_if(~F.col("is_punct")).alias("token_count"), F.count_if(~F.col("is_punct") & F.col("pos").isin(*lexical.CONTENT)).alias("content_count")]
    x = syntax.sentence_syntax(tokens, ("text", "lemma", "is_alpha", "is_punct"), (*density, lemmas, F.collect_list(F.when(F.col("is_alpha"), word)).alias("ws")))
    x = lexical.with_overlap(x).withColumn("lexical_density", F.try_divide(F.col("content_count").cast("double"), F.col("token_count").cast("double"))).drop("content_words")
    known = [c for c in x.columns if c not in ("doc_id", "sent_id", "ws")]
    # a sentence without words goes with a word that is none, and no hot key
    none = F.array(F.struct(F.concat_ws(" ", F.lit("\u0000"), F.col("doc_id").cast("string"), F.col("sent_id").cast("string")).alias("word"), F.lit(None).cast("int").alias("tok_id"), F.lit(False).alias("content")))
    each = x.select("doc_id", "sent_id", F.struct(*known).alias("m"), F.posexplode(F.when(F.size("ws") > 0, F.col("ws")).otherwise(none)).alias("at", "w"))
    each = each.select("doc_id", "sent_id", "w.*", F.when(F.col("at") == 0, F.col("m")).alias("m"))
    each = each.groupBy("doc_id", "sent_id", "word").agg(F.collect_list("tok_id").alias("tok_ids"), F.count_if("content").alias("content"), F.first("m", ignorenulls=True).alias("m"))
    met = scorer.log_probs(each.join(freqs.withColumnRenamed("freq", "corpus_freq"), "word", "left"))
    n, seen = F.size("tok_ids").cast("long"), F.col("corpus_freq").isNotNull()
    ic = F.when(seen, F.transform("tok_ids", lambda t: F.struct(t.alias("tok_id"), (-F.log(F.col("corpus_freq").cast("double"))).alias("ic"))))
    per = met.groupBy("doc_id", "sent_id").agg(
        F.first("m", ignorenulls=True).alias("m"), F.array_sort(F.flatten(F.collect_list(ic))).alias("ics"), F.sum(F.coalesce("corpus_freq", F.lit(1)) * n).alias("total"), F.sum(n).alias("words"), F.sum("content").alias("content"),
        F.collect_list(F.when(n > 0, F.struct((-F.col("log_prob")).alias("p"), n.alias("n")))).alias("ps"),
    ).select("doc_id", "sent_id", "m.*", "ics", "total", "words", "content", "ps")
    overall = F.broadcast(freqs.agg(F.avg("freq").alias("mean_freq")))  # one row
    per = per.withColumn("information_content", F.try_divide(F.aggregate("ics", F.lit(0.0), lambda a, s: a + s["ic"]), F.size("ics"))).withColumn("ic_count", F.size("ics").cast("long"))
    per = per.crossJoin(overall).withColumn("_mean", F.try_divide(F.col("total").cast("double"), F.when(F.col("words") > 0, F.col("words"))))
    per = per.withColumn("_norm", F.try_divide(F.col("_mean"), F.col("mean_freq"))).withColumn("_ratio", F.try_divide(F.col("content").cast("double"), (F.col("words") - F.col("content")).cast("double")))
    some = lambda c: F.when(F.col("words") > 0, F.coalesce(exact_round(c, 3), F.lit(0.0)))
    per = per.withColumns({"avg_word_freq": some("_mean"), "normalized_freq": some("_norm"), "content_function_ratio": some("_ratio")})
    return lm.surprisal_of(per, lm.overall_surprisal(tokens, scorer)).drop("ics", "total", "words", "content", "ps", "mean_freq", "_mean", "_norm", "_ratio")


def window_metrics(docs: DataFrame, size: int = 3, annotator: Annotator | None = None) -> DataFrame:
    """All window metrics of each document: syntax, density, information content, cohesion, surprisal, word frequency, and the sums of agent, predicate and patient structures (null in a last window that isn't full)."""
    if annotator is None:
        return Counted(docs).window_metrics(size)
    tokens = annotator.tokens(docs)
    rows = _totals(sentence_metrics(tokens, lexical.corpus_frequencies(docs), lm.UnigramScorer(docs)), size)
    rows = rows.withColumns({c: F.when(F.col("n") == size, F.col(c)) for c in TOTALS})
    means = [*CLAUSE, *DEPTH, *DEPENDENCY, "token_count", "content_count", "mean_surprisal", "surprisal_variance", "normalized_surprisal", "avg_word_freq", "normalized_freq", "content_function_ratio"]
    return tumbling(rows, size, means, firsts=["ic_count", *TOTALS], nullable=["lexical_density", "information_content", "cohesion_overlap"])


def network_nodes(docs: DataFrame, top: int | None = None, annotator: Annotator | None = None, embedder: concepts.Embedder | None = None) -> DataFrame:
    """(doc_id, node_id, text, vector): the concepts of each document, all of them or, with top, its commonest."""
    if annotator is None:
        phrases = local.noun_phrases(docs, concepts.STOP_WORDS, top)
    else:
        phrases = concepts.noun_phrases(annotator.tokens(docs))
        phrases = phrases if top is None else concepts.top_phrases(phrases, top)
    return (embedder or concepts.NGramEmbedder()).embed(phrases).select("doc_id", F.col("phrase_idx").cast("long").alias("node_id"), F.col("phrase").alias("text"), "vector")


def network(nodes: DataFrame, least: float = 0.3, errors: bool = False) -> dict[str, DataFrame]:
    """edges, centrality, communities, places, node_style and edge_style of the networks of nodes (doc_id, node_id, vector).

    errors: a document that fails doesn't stop the others; its results are null, and the table errors (doc_id, stage, error) says why.
    """
    edges = graph.similarity_edges(nodes, least)
    places = graph.places(nodes, edges, errors=errors)
    if errors:
        central, found = graph.centralities(nodes, edges, errors), graph.communities(nodes, edges, errors=errors)
        styles = {"node_style": graph.node_style(central, found), "edge_style": graph.edge_style(edges, central)}
    else:
        central, found = similar.centralities(nodes, least), similar.communities(nodes, least)
        # each style with what it needs alone
        scaled = similar.paths(nodes, least).select("doc_id", "node_id", min_max(F.col("betweenness"), Window.partitionBy("doc_id")).alias("b"))
        styles = {"node_style": graph.node_style(similar.settled(nodes, least), found), "edge_style": similar.edge_style(nodes.join(scaled, ["doc_id", "node_id"]), least)}
    out = {"edges": edges, "centrality": central, "communities": found, "places": places} | styles
    if errors:
        failed = [t.where("error is not null").select("doc_id", F.lit(name).alias("stage"), "error") for name, t in (("centrality", central), ("communities", found), ("places", places))]
        out["errors"] = reduce(lambda a, b: a.unionByName(b), failed).distinct()
    return out


def text_networks(docs: DataFrame, top: int | None = None, least: float = 0.3, annotator: Annotator | None = None, embedder: concepts.Embedder | None = None) -> dict[str, DataFrame]:
    """Concepts (nodes) and networks of every document, and the errors of those that failed."""
    nodes = network_nodes(docs, top, annotator, embedder)
    return {"nodes": nodes} | network(nodes, least, errors=True)
