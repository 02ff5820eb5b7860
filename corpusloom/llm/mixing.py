"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source). At each node it is divided among the children by weight, no child
getting more than its subtree can supply; what a child can't take goes to its siblings, by their weights, and only what all of
them can't take stays with the ancestors, whose other children then get it. A leaf fills its budget with whole epochs and a
prefix, by tokens, of one more epoch, whose order is a seeded hash of epoch and document.

The tree is a table and is divided level by level with window functions over siblings. The prefixes are found with sums by
hash range first, so that no leaf is sorted in one task; what each leaf finally has is one hash, up to which its documents belong to the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, quoted, whole_row

#: Documents of a leaf that are sorted in one task, about.
RANGE_ROWS = 2_000
#: Leaves that are joined by broadcast at most.
BROADCAST_LEAVES = 100_000
#: Relative weights among siblings (1 if not listed), by level and name.
Weights = dict[str, dict[str, int]]
def tokens_of(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def divide(nodes: DataFrame, level: str, parents: list[str], weights: dict) -> DataFrame:
    """budget of each node: of the parent's budget ``given``, by weight, at most cap. All numbers are whole."""
    order = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("w")).asc(), F.col(level).asc()).rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy(*parents)
    x = nodes.withColumn("w", _weight(level, weights))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(order), F.lit(0))).withColumn("w_all", F.sum("w").over(among))
    x = x.withColumn("full", F.col("cap") * (F.col("w_all") - F.col("w_before")) <= F.col("w") * (F.col("given") - F.col("cap_before")))
    x = x.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(among), F.lit(0))).withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(among), F.lit(0)))
    share = F.expr("w * greatest(given - cap_full, 0) div greatest(w_all - w_full, 1)")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)))


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], budget: int, epochs: int, weights: dict) -> DataFrame:
    """Budget of each leaf. leaves: (*levels, tokens, docs)."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(levels):
        parents, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = caps.groupBy(*own).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("given", F.lit(budget).cast("long")) if given is None else nodes.join(given, parents)
        given = divide(nodes, level, parents, weights).select(*own, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


def _place(seed: int, ident: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("null"))))


def _counted(docs: DataFrame, id_col: str, levels: tuple[tuple[str, Column], ...], tokens: Column, weights: Weights, share: float, epochs: int, seed: int) -> DataFrame:
    """(row, id, tokens, n, l0, l1, ...) for every row of docs: the row as a struct, its size, how often it is in the mixture, and its path in the tree."""
    names = tuple(f"l{k}" for k in range(len(levels)))
    by_name = {n: weights.get(level, {}) for n, (level, _) in zip(names, levels, strict=True)}
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (_, c) in zip(names, levels, strict=True)]
    small = docs.select(quoted(id_col).alias("id"), *keys, tokens.alias("tokens"))
    leaves = materialize(small.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, names, int(total * share), epochs, by_name)
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("budget div greatest(tokens, 1)"), F.lit(epochs).cast("long"))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.ceil(F.col("docs") / RANGE_ROWS))
    plan = materialize(plan.select(*names, "whole", "rest", "ranges"), "plan")
    few = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    hint = F.broadcast if few else lambda df: df

    placed = small.join(hint(plan.where("rest > 0")), list(names)).withColumn("place", _place(seed, F.col("id"), F.col("whole")))
    placed = placed.withColumn("range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("ranges") / (1 << 32)))
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*names, "range").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest")).withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    # the one range of each leaf in which the budget ends
    ends = materialize(ranges.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))).select(*names, "range", "before"), "ends")
    # rows of one place stand or fall together, so they are one row before they are sorted: a leaf of one id is no more work than any other
    inside = placed.join(hint(ends), [*names, "range"]).groupBy(*names, "range", "place").agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"), F.first("ranges").alias("ranges"))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("place"))
    cuts = inside.withColumn("ok", running <= F.col("rest")).groupBy(*names).agg(F.max(F.when(F.col("ok"), F.col("place"))).alias("cut"), F.min(F.format_string("%08x", F.ceil(F.col("range") * F.lit(1 << 32) / F.col("ranges")))).alias("from"))
    cuts = plan.join(cuts, list(names), "left").select(*names, "whole", F.when(F.col("rest") > 0, F.coalesce("cut", "from", F.lit("g"))).alias("cut"))
    cuts = materialize(cuts, "cuts")
    marked = docs.select(whole_row(docs).alias("row"), quoted(id_col).alias("id"), tokens.alias("tokens"), *keys).join(hint(cuts), list(names))
    extra = F.when(_place(seed, F.col("id"), F.col("whole")) <= F.col("cut"), 1).otherwise(0)
    return marked.select("row", "id", "tokens", (F.col("whole") + extra).alias("n"), *names)


def mixture(docs: DataFrame, levels: tuple[tuple[str, Column], ...], weights: Weights, id_col: str = "doc_id", tokens: Column | None = None, share: float = 0.8, epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs with the columns mix_tokens and mix_epochs, how often each row is in the mixture (0: not at all), and mix_<level> for each level.

    levels: names and columns of the tree from the top; weights: relative weights among siblings, by level and name (1 where
    none is given); tokens: size of a document; share: the budget as a part of all tokens; epochs: how often a document may be
    repeated at most. A prefix ends before the document that would exceed the budget. Nulls in a level are the empty name, a
    null text is empty and costs nothing, a text of any length counts whole, null ids are one id; rows with one id (ties) stand
    together in a leaf's order, so they are taken or left together; columns of docs keep their names and values, and a result
    whose name one of them has takes leading underscores; an empty table gives an empty result.
    """
    out = _counted(docs, id_col, levels, tokens_of(F.col("text")) if tokens is None else tokens, weights, share, epochs, seed)
    called = free_names(docs.columns, "mix_tokens", "mix_epochs", *[f"mix_{n}" for n, _ in levels])
    return out.select("row.*", *[F.col(c).alias(n) for c, n in zip(("tokens", "n", *[f"l{k}" for k in range(len(levels))]), called, strict=True)])


def mixed(docs: DataFrame, levels: tuple[tuple[str, Column], ...], weights: Weights, id_col: str = "doc_id", tokens: Column | None = None, share: float = 0.8, epochs: int = 2, seed: int = 17) -> DataFrame:
    """The mixture's rows with the columns of docs, each as often as mixture() says."""
    out = _counted(docs, id_col, levels, tokens_of(F.col("text")) if tokens is None else tokens, weights, share, epochs, seed).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("row.*")


def _sql_divide(name: str, source: str, level: str, parents: str) -> str:
    by = f"partition by {parents}" if parents else ""
    w = {"domain": "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end", "lang": "case lang when 'en' then 6 when 'de' then 2 else 1 end", "source": "1"}[level]
    return f"""
{name}a as (select *, ({w})::bigint as w from {source}),
{name}b as (select *, coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(w) over o, 0) as w_before, sum(w) over ({by}) as w_all from {name}a
  window o as ({by} order by cap::double / w, {level} rows between unbounded preceding and 1 preceding)),
{name}c as (select *, cap * (w_all - w_before) <= w * (given - cap_before) as sat from {name}b),
{name}d as (select *, coalesce(sum(case when sat then cap end) over ({by}), 0) as cap_full, coalesce(sum(case when sat then w end) over ({by}), 0) as w_full from {name}c),
{name} as (select *, case when sat then cap else least(cap, w * greatest(given - cap_full, 0) // greatest(w_all - w_full, 1)) end::bigint as budget from {name}d)"""


ORACLE = f"""
with s as (select doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1), '') as bigint), 0) % 4) as domain,
  coalesce(lang, '') as lang, coalesce(source, '') as source, ((strlen(coalesce(text, '')) + 3) // 4)::bigint as tokens from documents),
leaf as (select domain, lang, source, sum(tokens)::bigint as tokens from s group by all),
n1 as (select domain, sum(tokens * 2)::bigint as cap, (select floor(sum(tokens)::bigint * 0.8)::bigint from leaf) as given from leaf group by domain),{_sql_divide("r1", "n1", "domain", "")},
n2 as (select l.domain, l.lang, sum(l.tokens * 2)::bigint as cap, any_value(r1.budget) as given from leaf l join r1 on l.domain = r1.domain group by l.domain, l.lang),{_sql_divide("r2", "n2", "lang", "domain")},
n3 as (select l.domain, l.lang, l.source, l.tokens * 2 as cap, l.tokens as tokens, r2.budget as given from leaf l join r2 on l.domain = r2.domain and l.lang = r2.lang),{_sql_divide("r3", "n3", "source", "domain, lang")},
plan as (select domain, lang, source, case when tokens > 0 then least(budget // tokens, 2) else 0 end as whole, budget - (case when tokens > 0 then least(budget // tokens, 2) else 0 end) * tokens as rest from r3),
pl as (select s.*, whole, rest, md5('17|' || whole || '|' || coalesce(doc_id::varchar, 'null')) as place from s join plan p on s.domain = p.domain and s.lang = p.lang and s.source = p.source),
run as (select *, sum(tokens) over (partition by domain, lang, source order by place) as upto from pl)
select doc_id, domain, lang, source, tokens, (whole + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint as n_epochs from run
"""
