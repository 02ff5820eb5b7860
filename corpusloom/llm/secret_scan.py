"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, for each blob, the rule versions that
have seen it and what each version found. A scan takes the blobs with at least one pending rule version, finds the spans of each
such blob once however many paths carry it, and joins the findings back to all paths. Texts in which no pattern occurs at all are
not shuffled: each is passed over where it lies, and only the addresses go into the ledger.

A match's place is found without a user function: ``split`` gives the gaps between the matches and ``regexp_extract_all`` the
matches themselves, in the same order, so a running sum of their lengths is the position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, quoted, text_or_empty
from .components import bounded


@dataclass(frozen=True)
class Rule:
    """kind: name in reports. version: raise it when the pattern changes, and blobs are scanned again. group, least: matches whose group is shorter than least are dropped after they have consumed their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: For a run of one class, a least length inside the pattern gives the same matches as dropping short ones afterwards.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Blobs with findings that are joined to their paths by broadcast at most.
FEW = 50_000
FOUND = "array<struct<start:bigint,rank:int,end:bigint,rule:string,version:string>>"
LEDGER = f"blob binary, scanned array<string>, found {FOUND}"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def candidate(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether some rule's pattern occurs in the text."""
    return text.rlike("|".join(f"(?:{r.pattern})" for r in rules))


def pending_blobs(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], ledger: DataFrame | None, whole: bool = True) -> DataFrame:
    """(blob, text, pending): each blob that some rule version hasn't seen, once. Copies meet in map-side aggregation first, so a blob that a third of all paths share costs one row a task.

    whole: whether all texts are asked for; else those without a candidate of any rule are null, and stay where they lie instead of being shuffled.
    """
    text = text_or_empty(text_col)
    every = F.array(*[F.lit(r.key) for r in rules])
    blobs = docs.select(address(text).alias("blob"), text.alias("text"))
    if ledger is not None:
        # the addresses alone meet the ledger; the texts meet what is left of them
        scanned = F.coalesce("scanned", F.array().cast("array<string>"))
        fresh = blobs.select("blob").distinct().join(ledger.select("blob", "scanned"), "blob", "left").select("blob", F.array_except(every, scanned).alias("pending"))
        fresh = materialize(fresh.where(F.size("pending") > 0), "pending")
        if fresh.isEmpty():
            return blobs.join(fresh.limit(0), "blob").select("blob", "text", "pending")
        # where nearly all is pending, the texts are made distinct first and meet the addresses then
        few = bounded(fresh, FEW)
        blobs = blobs.join(few, "blob", "left_semi") if few is not fresh else blobs
    kept = F.col("text") if whole else F.when(candidate(F.col("text"), rules), F.col("text"))
    blobs = blobs.select("blob", kept.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.withColumn("pending", every) if ledger is None else blobs.join(fresh, "blob")


def _sizes(rank: int, least: int):
    return lambda m: F.struct(F.lit(rank).alias("rank"), F.char_length(m["gap"]).alias("gap"), F.char_length(m["whole"]).alias("len"), (F.char_length(m["part"]) >= least).alias("ok"))


def _of_kind(kind: str):
    return lambda s: s["rule"] == kind


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): the spans of every pending rule in each blob that has any, by start and then by the order of the rules. Positions count code points, ends are exclusive."""
    none = F.array().cast("array<struct<rank:int,gap:int,len:int,ok:boolean>>")
    hits = []
    for rank, r in enumerate(rules):
        gaps, whole = F.split("text", r.pattern, -1), F.regexp_extract_all("text", F.lit(r.pattern), 0)
        part = F.regexp_extract_all("text", F.lit(r.pattern), r.group)
        found = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), whole.alias("whole"), part.alias("part"))
        rows = F.transform(found, _sizes(rank, r.least))
        hits.append(F.when(F.array_contains("pending", r.key), rows).otherwise(none))
    each = blobs.where(candidate(F.col("text"), rules)).select("blob", F.posexplode(F.concat(*hits)).alias("k", "m")).select("blob", "k", "m.*")
    upto = Window.partitionBy("blob", "rank").orderBy("k")
    ends = each.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto)).where("ok")
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "end", name.alias("rule"), version.alias("version"))
    return ends.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(FOUND).alias("found"))


def extend_ledger(ledger: DataFrame | None, blobs: DataFrame, found: DataFrame) -> DataFrame:
    """The ledger after a scan: what it held, the newly scanned rule versions of each blob, and their findings."""
    none = F.array().cast(FOUND)
    now = blobs.select("blob", F.col("pending").alias("scanned")).join(found, "blob", "left").select("blob", "scanned", F.coalesce("found", none).alias("found"))
    if ledger is None:
        return now
    both = ledger.select("blob", "scanned", "found").unionByName(now)
    return both.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scanned")))).alias("scanned"), _merged().alias("found"))


def _merged() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).cast(FOUND)


def _current(found: Column, rules: tuple[Rule, ...]) -> Column:
    """The findings of these versions of the rules, with the rules' present ranks."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    place = lambda s: F.array_position(keys, F.concat_ws("@", s["rule"], s["version"])).cast("int")
    ranked = lambda s: F.struct(s["start"].alias("start"), (place(s) - 1).alias("rank"), s["end"].alias("end"), s["rule"].alias("rule"), s["version"].alias("version"))
    return F.transform(F.filter(found, lambda s: place(s) > 0), ranked).cast(FOUND)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def updated_ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after docs have been scanned by the rule versions that it doesn't hold for their blobs, as a table in the shared folder; write it where the next scan finds it."""
    blobs = materialize(pending_blobs(docs, text_col, rules, ledger, whole=False), "blobs")
    out = materialize(extend_ledger(ledger, blobs, scan_blobs(blobs, rules)), "ledger")
    discard(blobs)
    return out


def scan_paths(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(path, blob, found) for every row of docs; found is empty where nothing was found.

    A null or empty text is the empty blob and has no findings; a text of any length is read whole; a null path stays null;
    repeated rows each keep their row; findings at one place (ties) stand in the order of the rules; columns other than the two
    named are ignored; an empty table gives an empty result. With a ledger (see updated_ledger), only rule versions that haven't
    seen a blob are run, and findings of the same rule versions come from the ledger: those of other versions are left out, and
    no finding can come twice.
    """
    book = updated_ledger(docs, text_col, rules, ledger)
    found = book.select("blob", _current(F.col("found"), rules).alias("found")).where(F.size("found") > 0)
    # written first: the join then has an exchange of its own on both sides, and adaptive execution can split a blob of many paths
    found = bounded(materialize(found, "findings"), FEW)
    paths = docs.select(quoted(path_col).alias("path"), address(text_or_empty(text_col)).alias("blob"))
    return paths.join(found, "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def report(found: DataFrame, path_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind and a digest of the spans, for each row of scan_paths()."""
    base = F.filter("found", lambda s: s["rank"] < 3)
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(path_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle_kind(rank: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""
    select doc_id, {rank} as rank, '{r.kind}' as kind, m, g, gap, idx from (
      select doc_id, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', {r.group})) as g,
             unnest(list_slice(string_split_regex(t, '{p}'), 1, -2)) as gap, unnest(range(len(regexp_extract_all(t, '{p}')))) as idx
      from d where regexp_matches(t, '{p}'))"""


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
hits as ({' union all '.join(_oracle_kind(k, r) for k, r in enumerate(RULES))}),
ends as (select doc_id, rank, kind, g, length(m) as len, sum(length(gap) + length(m)) over (partition by doc_id, rank order by idx) as stop from hits),
ok as (select * from ends where length(g) >= case when rank = 0 then 8 else 1 end),
s as (select doc_id, count(*) filter (where rank = 0) as a, count(*) filter (where rank = 1) as b, count(*) filter (where rank = 2) as c,
      string_agg(kind || ':' || (stop - len)::bigint || ':' || stop::bigint, ',' order by stop - len, rank) as j from ok group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
       sha256(coalesce(j, '')) as base_sha256, coalesce(j, '') as spans
from d left join s on d.doc_id = s.doc_id
"""
