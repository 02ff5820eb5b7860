"""Exact deduplication by distributed MSD radix partitioning: equality is decided on the bytes, never on a digest.

Texts are split by successive slices of their bytes. A group of one text is done; a group whose slice is shorter than its width
has ended, and its members are equal; every other group is split again by the next slice. The first slice parts nearly all
texts, so only copies and texts with common beginnings carry their bytes into later rounds. Each round aggregates within tasks
before it shuffles and joins the few groups back, so that a group of copies may hold a third of all rows; each round's state is
a table in the shared folder.

Groups are found by the bytes of their slices, and rows find their group by a tag of 64 bits, so that no slice is joined. A tag is
only a name: whether two slices of a group share one is counted, and what shares a tag stays together, uncut, for the next round,
whose tags are others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

#: Bytes by which each round splits; after the last, every round is four times as wide as the one before, up to WIDEST.
WIDTHS = (64, 1 << 10, 1 << 14, 1 << 18, 1 << 20)
WIDEST = 1 << 26
#: Groups that are joined by broadcast at most, in bytes, of which a group has about GROUP_BYTES. Beyond it the join shuffles.
BROADCAST_BYTES, GROUP_BYTES = 16 << 20, 64


def _widths() -> Iterator[int]:
    yield from WIDTHS
    width = WIDTHS[-1]
    while True:
        width = max(width, min(4 * width, WIDEST))
        yield width


def tagged(cut: Column, level: int) -> Column:
    return F.xxhash64(cut, F.lit(level))


def _split(state: DataFrame, width: int, level: int) -> DataFrame:
    """One round: state (id, sha, gid, rest) to (uid, id, sha, gid, n, keep, done, rest)."""
    cut = F.substring("rest", 1, width)
    slices = state.groupBy("gid", cut.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    slices = slices.select("gid", tagged(F.col("slice"), level).alias("tag"), "n", "keep", (F.octet_length("slice") < width).alias("ended"))
    groups = slices.groupBy("gid", "tag").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"), F.first("ended").alias("ended"), (F.count(F.lit(1)) > 1).alias("shared")).where("n > 1")
    groups = made = materialize(groups.withColumn("next", F.monotonically_increasing_id()), f"groups{level}")
    if groups.count() * GROUP_BYTES <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    out = state.withColumn("tag", tagged(cut, level)).alias("s").join(groups.alias("g"), F.expr("s.gid = g.gid and s.tag = g.tag"), "left")
    single, done = F.col("n").isNull(), F.coalesce(F.col("ended") & ~F.col("shared"), F.lit(True))
    out = out.select(
        F.monotonically_increasing_id().alias("uid"), "s.id", "sha", F.coalesce("g.next", F.lit(-1)).alias("gid"), F.coalesce("n", F.lit(1)).alias("n"),
        F.when(single, F.col("s.id")).otherwise(F.col("keep")).alias("keep"), done.alias("done"), F.when(~done, F.when(F.col("shared"), F.col("rest")).otherwise(F.expr(f"substring(rest, {width + 1})"))).alias("rest"),
    )
    out = materialize(out, f"split{level}")
    discard(made)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the largest id stays. A null text counts as empty; a null id is smaller than any other; of
    repeated rows (same text and id) exactly one is kept; texts of any length are compared whole, in rounds of growing width; other
    columns are ignored, whatever their names; an empty table gives an empty result. text_sha256 is reported only: no decision reads it.
    """
    text = text_or_empty(text_col)
    state = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.lit(0).cast("long").alias("gid"), text.cast("binary").alias("rest"))
    finished: list[DataFrame] = []
    for level, width in enumerate(_widths()):
        out = _split(state, width, level)
        finished.append(out.where("done").select("uid", "id", "sha", "n", "keep", "gid", F.lit(level).alias("level")))
        state = out.where("not done").select("id", "sha", "gid", "rest")
        if state.isEmpty():
            break
    rows = finished[0]
    for more in finished[1:]:
        rows = rows.unionByName(more)
    shape = (F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = rows.where("n = 1").select(*shape, F.lit(True).alias("kept"), sha)
    # among rows with the kept id, repeated rows are told apart by a number written with the state
    won = rows.where("n > 1 and id <=> keep").groupBy("level", "gid").agg(F.max("uid").alias("uid"))
    copies = rows.where("n > 1").join(won.withColumn("won", F.lit(True)), ["level", "gid", "uid"], "left")
    return single.unionByName(copies.select(*shape, F.coalesce("won", F.lit(False)).alias("kept"), sha))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size::bigint as group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
