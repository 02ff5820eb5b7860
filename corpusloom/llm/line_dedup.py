"""Site-relative line deduplication, in DataFrame operations only.

Pages are grouped by host. For each line of a host, the share of the host's pages that hold it is its boilerplate ratio; lines
above the limit are dropped from the pages of that host and of no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, quoted
from .components import bounded

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: What comes first hides what it holds; then the head, which ends with its tag or before the first element of a body. What is never closed goes up to the page's end, so that no text is gone over again for every opening tag.
HIDDEN = (
    r"(?is)<(?:script\b(?:[^<]++|<(?!/script\s*>))*+(?:</script\s*>)?|style\b(?:[^<]++|<(?!/style\s*>))*+(?:</style\s*>)?|!--(?:[^-]++|-(?!->))*+(?:-->)?)",
    r"(?is)<head\b(?:[^<]++|<(?!/head\s*>|(?:body|p|div|h[1-6]|main|article|section|header|footer|nav|table|ul|ol|pre|blockquote|form)\b))*+(?:</head\s*>)?",
)
BREAKS = r"(?i)</?(?:p|br|div|li|ul|ol|nav|h[1-6]|tr|table|td|th|header|footer|article|section|aside|main|body|html|title|blockquote|pre)\b[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&amp;", "&"))
#: The table of dropped lines is broadcast up to this size; beyond it, it is joined by host, and a host's pages are dealt over a task for every SALT_PAGES of them.
BROADCAST_BYTES, SALT_PAGES = 16 << 20, 20_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(host != "", host)


def visible_text(html: Column) -> Column:
    """The text a reader sees, a line for each block element."""
    text = F.coalesce(html, F.lit(""))
    for hidden in HIDDEN:
        text = F.regexp_replace(text, hidden, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    # few lines hold an entity
    return F.element_at(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t)).otherwise(t)), 1)


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def lines_of(text: Column) -> Column:
    """Lines without white space at their ends and in runs; empty ones are left out."""
    # single blanks, nearly all there are, match nothing
    lines = F.split(F.regexp_replace(text, r" [ \t\r\f\x0B]++|[\t\r\f\x0B][ \t\r\f\x0B]*+", " "), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, pages, line): the lines of each host above the ratio, with the host's number of pages. pages: (host, lines)."""
    sited = pages.where("host is not null")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = sited.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # the lines of a giant host are many before the ratio is asked: the totals, a row a host, are the side that is broadcast where they are few
    return held.join(bounded(materialize(totals, "hosts")), "host").where(F.col("n") > ratio * F.col("pages")).select("host", "pages", "line")


def line_dedup(pages: DataFrame, url_col: str = "url", text: Column | None = None, keep: tuple[str, ...] = ("page_id",), ratio: float = 0.1, least: int = 3) -> DataFrame:
    """A row for each row of pages: the columns keep, host, n_lines, n_dropped and text, the remaining lines.

    text: what to split into lines (the visible text of html by default). A line is dropped if more than ratio of its host's
    pages, and at least ``least`` of them, hold it (a tie with the ratio stays); on each page it counts once, and all its
    occurrences go. A null or empty text has no lines; a text of any length is read whole; a page whose URL is null or has no
    host keeps all its lines; repeated rows are pages of their own; nulls in kept columns stay; other columns are ignored, and a
    result whose name a kept column has takes leading underscores; an empty table gives an empty result.

    A host's list is bounded by its mean number of lines a page divided by the ratio, so it fits a row.
    """
    names = [f"k{k}" for k in range(len(keep))]
    host = host_of(quoted(url_col)).alias("host")
    source = pages.select(*[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)], host, lines_of(visible_text(F.col("html")) if text is None else F.coalesce(text, F.lit(""))).alias("lines"))
    # the lines are read twice, and worked out once; what has no type can't be written
    untyped = {n for n, kind in source.dtypes if kind == "void"}
    source = materialize(source.drop(*untyped), "lines")
    found = boilerplate(source.select("host", "lines"), ratio, least)
    drop = materialize(found.groupBy("host").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list("line")).alias("dropped")), "boilerplate")
    size = drop.select(F.sum(F.aggregate("dropped", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(drop), "host", "left")
    else:
        # as many tasks for a host as it has pages, by measure: a small host's list is sent once
        salts = F.ceil(F.col("pages") / SALT_PAGES)
        sizes = bounded(materialize(drop.select("host", salts.alias("salts")), "salts"))
        salted = source.join(sizes, "host", "left").withColumn("salt", F.pmod(F.xxhash64(*[n for n in names if n not in untyped], F.size("lines"), F.get("lines", F.lit(0))), F.coalesce("salts", F.lit(1))))
        every = drop.select("host", "dropped", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        joined = salted.join(every, ["host", "salt"], "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("dropped"), x))
    left = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(kept)
    out = joined.select(*[F.lit(None).alias(n) if n in untyped else n for n in names], "host", F.size("lines").alias("n"), left.alias("left"))
    results = (F.col("host"), F.col("n").cast("long"), (F.col("n") - F.size("left")).cast("long"), F.array_join("left", "\n"))
    called = free_names(keep, "host", "n_lines", "n_dropped", "text")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[r.alias(n) for r, n in zip(results, called, strict=True)])


def _oracle_text() -> str:
    """What a reader sees, from the definition: written anew, without the operator's constants."""
    text = "coalesce(html, '')"
    for hidden in ("<!--.*?-->|<style\\b.*?</style>|<script\\b.*?</script>", "<head\\b.*?</head>"):
        text = f"regexp_replace({text}, '(?is){hidden}', '', 'g')"
    blocks = "p br div li ul ol nav h1 h2 h3 h4 h5 h6 tr table td th header footer article section aside main body html title blockquote pre"
    text = f"regexp_replace({text}, '(?i)</?({blocks.replace(' ', '|')})\\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    codes = {"lt": 60, "gt": 62, "quot": 34, "#39": 39, "apos": 39, "nbsp": 32, "#160": 32, "ndash": 8211, "mdash": 8212, "hellip": 8230, "amp": 38}
    for name, code in codes.items():
        text = f"replace({text}, '&{name};', chr({code}))"
    return text


ORACLE = f"""
with p as (select page_id, url, nullif(regexp_extract(lower(url), '://([^/?#]*@)?([^/:?#]+)', 2), '') as host,
  list_filter(list_transform(string_split(regexp_replace({_oracle_text()}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from pages),
t as (select host, count(*) as n from p where host is not null group by host),
l as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from p where host is not null) group by host, line having count(*) >= 3),
b as (select l.host, list(l.line) as dropped from l join t on l.host = t.host where l.n > 0.1 * t.n group by l.host),
k as (select page_id, p.host, lines, list_filter(lines, lambda x: not list_contains(coalesce(dropped, []), x)) as kept from p left join b on p.host = b.host)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, coalesce(array_to_string(kept, chr(10)), '') as text from k
"""
