"""Syntactic metrics of sentences over the tokens table, for any annotator's trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.text import evaluated, safe_ratio
from .annotate import SUBORDINATE

ROLES = ("nsubj", "dobj", "iobj", "pobj")


def _clause_columns() -> list[Column]:
    dep = F.col("dep")
    return [F.count_if(dep == "ROOT").alias("main"), F.count_if(dep.isin(*SUBORDINATE)).alias("subordinate"), F.count_if(dep == "conj").alias("coordinate")]


def _with_ratios(x: DataFrame) -> DataFrame:
    x = x.withColumns({"_s": safe_ratio(F.col("subordinate").cast("double"), F.col("main").cast("double")), "_c": safe_ratio(F.col("coordinate").cast("double"), F.col("main").cast("double"))})
    return x.withColumns({"subordination_ratio": exact_round("_s"), "coordination_ratio": exact_round("_c")})


def clause_metrics(tokens: DataFrame) -> DataFrame:
    """Per sentence: main, subordinate and coordinate clauses, and the latter two per main clause."""
    return _with_ratios(tokens.groupBy("doc_id", "sent_id").agg(*_clause_columns())).drop("_s", "_c")


def sentence_trees(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, t): a sentence's tokens in order, each with the place of its head in the sentence."""
    rows = F.array_sort(F.collect_list(F.struct("tok_id", "head_id", "dep", "text", "pos", "lemma")))
    x = tokens.groupBy("doc_id", "sent_id").agg(rows.alias("t"))
    first = F.col("t")[0]["tok_id"]
    # tokens of a sentence are numbered without gaps
    return evaluated(x, up=F.transform("t", lambda s: s["head_id"] - first))


def depths(up: Column) -> Column:
    """Steps from each token to the root, by pointer doubling: as many rounds as the length has bits, for trees of any depth."""
    start = F.struct(up.alias("up"), F.transform(up, lambda x, i: F.when(x == i, F.lit(0)).otherwise(F.lit(1))).alias("d"))

    def double(s: Column, _: Column) -> Column:
        return F.struct(F.transform(s["up"], lambda x: F.get(s["up"], x)).alias("up"), F.zip_with(s["d"], s["up"], lambda d, x: d + F.get(s["d"], x)).alias("d"))

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(up).cast("double"))), F.lit(1)).cast("int"))
    return F.aggregate(rounds, start, double, lambda s: s["d"])


def _depth_columns() -> list[Column]:
    """From d, the sorted depths of a sentence's tokens."""
    n = F.size("d")
    total = F.aggregate("d", F.lit(0).cast("long"), lambda a, v: a + v).cast("double")
    middle = (F.get("d", F.floor((n - 1) / 2).cast("int")) + F.get("d", F.floor(n / 2).cast("int"))).cast("double") / 2
    return [F.array_max("d").alias("max_depth"), (total / n).alias("mean_depth"), middle.alias("median_depth"), (total / n - middle).alias("depth_skew")]


def embedding_depth(tokens: DataFrame) -> DataFrame:
    """Per sentence: max, mean and median depth of its tokens, and mean minus median."""
    x = evaluated(sentence_trees(tokens).select("doc_id", "sent_id", "up"), d=F.array_sort(depths(F.col("up"))))
    return x.select("doc_id", "sent_id", *_depth_columns())


def _arcs(tokens: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, sent_id, tok_id, dep, head_id, n, far, *carried): each token with the number of its dependents and the length of their arcs. Tokens and arcs meet in one grouping, which finds a document's rows in place, instead of a join."""
    own = F.struct(F.col("tok_id").alias("k"), F.col("dep").alias("dep"), F.col("head_id").alias("head_id"), F.lit(0).alias("n"), F.lit(0).alias("far"), *[F.col(c) for c in carried])
    arc = F.struct(F.col("head_id").alias("k"), F.lit(None).cast("string").alias("dep"), F.lit(None).cast("int").alias("head_id"), (F.col("head_id") != F.col("tok_id")).cast("int").alias("n"), F.abs(F.col("tok_id") - F.col("head_id")).alias("far"), *[F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in carried])
    both = tokens.select("doc_id", "sent_id", F.explode(F.array(own, arc)).alias("x")).select("doc_id", "sent_id", "x.*")
    return both.groupBy("doc_id", "sent_id", F.col("k").alias("tok_id")).agg(F.max("dep").alias("dep"), F.max("head_id").alias("head_id"), F.sum("n").alias("n"), F.sum("far").alias("far"), *[F.max(c).alias(c) for c in carried])


def _dependency_columns() -> list[Column]:
    dep, sub = F.col("dep"), F.col("dep").isin(*SUBORDINATE)
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("n"))), F.lit(0.0))
    heads = dep.isin("ROOT", "conj", *SUBORDINATE)
    return [
        mean(dep == "ROOT").alias("main_clause"), mean(sub).alias("subordinate_clause"), mean(dep == "conj").alias("coordinate_clause"), F.coalesce(F.max(F.when(heads, F.col("n"))), F.lit(0)).alias("max_dependents"),
        F.coalesce(F.try_divide(F.sum("far").cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("mean_dependency_distance"),
    ]


def dependency_complexity(tokens: DataFrame) -> DataFrame:
    """Per sentence: mean dependents of main, subordinate and coordinate heads and the most among them (0 without such heads), and mean length of all arcs (0 without any)."""
    return _arcs(tokens).groupBy("doc_id", "sent_id").agg(*_dependency_columns())


def sentence_syntax(tokens: DataFrame, carried: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Clause metrics, depths and dependencies of each sentence in one pass over its tokens. carried, more: further columns of tokens, and aggregates over them."""
    x = _arcs(tokens, "pos", *carried).groupBy("doc_id", "sent_id").agg(*_clause_columns(), *_dependency_columns(), F.array_sort(F.collect_list(F.struct("tok_id", "head_id", "dep", "pos"))).alias("t"), *more)
    x = evaluated(x, up=F.transform("t", lambda s: s["head_id"] - F.get("t", F.lit(0))["tok_id"]))
    x = evaluated(x, d=F.array_sort(depths(F.col("up"))))
    return with_clause_counts(_with_ratios(x).select("*", *_depth_columns())).drop("t", "up", "d", "_s", "_c")


def semantic_roles(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, semantic_roles array<struct<role, text, head>>, role_count) of every sentence: its subjects and objects in order, with their heads' texts; empty without any."""
    x = sentence_trees(tokens)
    rows = F.filter(F.transform("t", lambda s, i: F.struct(s["dep"].alias("role"), s["text"].alias("text"), F.get(F.col("t"), F.get(F.col("up"), i))["text"].alias("head"))), lambda s: s["role"].isin(*ROLES))
    return x.select("doc_id", "sent_id", rows.alias("semantic_roles")).withColumn("role_count", F.size("semantic_roles"))


def clause_level(dep: Column) -> Column:
    """What a verb of that dependency heads: main, subordinate or coordinate; null for no clause."""
    level = F.when(dep == "ROOT", "main")
    for part in SUBORDINATE:
        level = level.when(dep.contains(part), "subordinate")
    return level.when(dep == "conj", "coordinate")


def _levels(t: Column) -> Column:
    return F.transform(t, lambda s: F.when(s["pos"] == "VERB", clause_level(s["dep"])))


def _named(s: Column, i: Column, what: str) -> Column:
    """Whether token i is a child, of that kind, of a verb that heads a clause."""
    head = F.get(F.col("up"), i)
    return (head != i) & F.get(F.col("level"), head).isNotNull() & s["dep"].contains(what)


def with_clause_counts(x: DataFrame) -> DataFrame:
    """x (t, up, ...) with num_clauses, num_agents and num_patients: the verbs that head a clause, and those of them with a subject and with an object."""
    heads = lambda what: F.size(F.array_distinct(F.filter(F.transform("t", lambda s, i: F.when(_named(s, i, what), F.get(F.col("up"), i))), lambda h: h.isNotNull())))
    x = evaluated(x, level=_levels(F.col("t")))
    return x.withColumns({"num_clauses": F.size(F.filter("level", lambda v: v.isNotNull())), "num_agents": heads("subj"), "num_patients": heads("obj")}).drop("level")


def clause_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, num_clauses, num_agents, num_patients) of every sentence."""
    return with_clause_counts(sentence_trees(tokens)).select("doc_id", "sent_id", "num_clauses", "num_agents", "num_patients")


def clauses(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, clause_level, predicate, agent, patient, clause_tokens), a row for each verb that heads a clause.

    The predicate is its lemma; agent and patient are the whole subtrees of its subjects and of its objects, several of a kind
    joined by "; " and null without any; clause_tokens is its own subtree. Each token is dealt to those of its ancestors that are
    such a verb, subject or object, so the work is the size of the result plus the depths of the tokens.
    """
    x = sentence_trees(tokens)
    up, t = F.col("up"), F.col("t")
    x = evaluated(x, level=_levels(t), deep=F.array_max(depths(up)))
    x = evaluated(x, role=F.transform("t", lambda s, i: F.when(_named(s, i, "subj"), 1).otherwise(0) + F.when(_named(s, i, "obj"), 2).otherwise(0)))
    def met(state: Column, at: Column) -> Column:
        wanted = F.get(F.col("level"), at).isNotNull() | (F.get(F.col("role"), at) > 0)
        return F.struct(F.when(wanted, F.concat(state, F.array(at))).otherwise(state).alias("path"), F.get(up, at).alias("next"), (F.get(up, at) == at).alias("done"))

    def path(i: Column) -> Column:
        # from the token to the root; what is past the root changes nothing
        start = met(F.array().cast("array<int>"), i)
        return F.aggregate(F.sequence(F.lit(0), F.col("deep")), start, lambda s, _: F.when(s["done"], s).otherwise(met(s["path"], s["next"])), lambda s: s["path"])

    x = evaluated(x, path=F.transform("t", lambda s, i: path(i)))
    each = F.arrays_zip(t.alias("t"), up.alias("up"), F.col("level").alias("level"), F.col("role").alias("role"), F.col("path").alias("path"))
    rows = x.select("doc_id", "sent_id", F.posexplode(each).alias("i", "x")).select("doc_id", "sent_id", "i", "x.up", "x.level", "x.role", "x.t.tok_id", "x.t.lemma", "x.t.text", F.explode("x.path").alias("a"))
    own = lambda c: F.max(F.when(F.col("i") == F.col("a"), F.col(c))).alias(c)
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"])
    trees = rows.groupBy("doc_id", "sent_id", "a").agg(*[own(c) for c in ("up", "level", "role", "tok_id", "lemma")], words.alias("words"))
    # a tree stands for its verb, as the clause itself, as a subject or as an object
    part = F.struct("a", F.array_join("words", " ").alias("s"))
    kinds = F.array(
        F.when(F.col("level").isNotNull(), F.struct(F.col("a").alias("verb"), F.lit(0).alias("kind"))),
        F.when(F.col("role").bitwiseAND(1) > 0, F.struct(F.col("up").alias("verb"), F.lit(1).alias("kind"))),
        F.when(F.col("role").bitwiseAND(2) > 0, F.struct(F.col("up").alias("verb"), F.lit(2).alias("kind"))),
    )
    dealt = trees.withColumn("part", part).select("doc_id", "sent_id", "tok_id", "level", "lemma", "words", "part", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("*", "k.verb", "k.kind")
    clause = lambda c: F.max(F.when(F.col("kind") == 0, F.col(c)))
    phrases = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("part")))), lambda s: s["s"]), "; ")
    some = lambda k: F.count_if(F.col("kind") == k) > 0
    return dealt.groupBy("doc_id", "sent_id", "verb").agg(
        clause("tok_id").alias("tok_id"), clause("level").alias("clause_level"), clause("lemma").alias("predicate"), F.when(some(1), phrases(1)).alias("agent"), F.when(some(2), phrases(2)).alias("patient"), clause("words").alias("clause_tokens"),
    ).drop("verb")


def semantic_structures(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, clauses, num_clauses, num_agents, num_patients) of every sentence: its clauses in order, and how many there are, with an agent and with a patient."""
    fields = ("tok_id", "clause_level", "predicate", "agent", "patient", "clause_tokens")
    found = clauses(tokens).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("clauses"))
    every = tokens.select("doc_id", "sent_id").distinct().join(found, ["doc_id", "sent_id"], "left")
    n = lambda c: F.coalesce(F.size(F.filter("clauses", lambda s: s[c].isNotNull())), F.lit(0))
    return every.select("doc_id", "sent_id", F.coalesce("clauses", F.array()).alias("clauses"), n("tok_id").alias("num_clauses"), n("agent").alias("num_agents"), n("patient").alias("num_patients"))
