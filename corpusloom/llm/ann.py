"""Nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a few pivots. The first pivot, or the first two where many vectors begin
alike, is the cell that it lies in; small cells share a shard, large ones have several. Within a shard each pivot has an inverted
file of the ranks that the shard's vectors give it (a vector stands in the files of its nearest ``posted`` pivots, and at that
rank in the others).

1. A query goes to the one shard of the cell that lies best for it, adds up the footrule distance over the files of the pivots
   that it posts itself, and reranks the nearest by the exact inner product of the original vectors. What it finds there is a
   guess, and its worst hit a floor.
2. With its floor it goes to every other shard with a cell that can reach it, and to no other: by the triangle inequality of
   angles a query is at least as far from a cell as its angle to any pivot lies outside the range of the cell's angles to that
   pivot. Within a shard, cells that can't reach the floor are passed over as well.

So nothing is cut and results are exact; how much is searched depends on how far the vectors lie in groups. Equal vectors are one
entry with its smallest ids, as many as a query can return.

No task holds more than a shard and a batch of queries: entries and queries lie in rows of some KB, and a task reads a shard's
entries and then its queries as a stream. The shards are gone through in rounds, so that a round's queries fit the disk; each
round begins with the floors that those before it have raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialize, sliced

#: Entries of a shard, and queries that go to it together, about.
SHARD, QUERY_BLOCK = 4096, 1024
#: Distinct vectors in the sample that pivots are taken from, for each pivot.
SPREAD = 16
#: Bytes of the vectors in a row of a table between steps, about (Parquet's reader decodes thousands of rows at once), and of those that go to the shards in one round.
ROW_BYTES, ROUND_BYTES = 8 << 10, 4 << 30
QUERIES, BLOCK = "array<struct<id:long,floor:double,vector:array<double>>>", "array<struct<vector:array<double>,ids:array<long>>>"
ASKED, DEALT = f"shard long, queries {QUERIES}", f"shard long, block {BLOCK}"
HITS = "query_id long, vec_id long, score double"


def _cosines(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of x with each pivot."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T


def _permutations(cosines: np.ndarray, posted: int) -> np.ndarray:
    """Rank that each row gives each pivot; posted for those beyond its nearest."""
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :posted]
    ranks = np.full(cosines.shape, posted, np.int16)
    np.put_along_axis(ranks, order, np.arange(order.shape[1], dtype=np.int16)[None].repeat(len(cosines), 0), 1)
    return ranks


def _prefixes(cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the one after it (the same one if there is no other)."""
    first, rows = cosines.argmax(axis=1), np.arange(len(cosines))
    rest = cosines.copy()
    rest[rows, first] = -np.inf
    return first, rest.argmax(axis=1) if cosines.shape[1] > 1 else first


@dataclass
class Bounds:
    """Of some groups of vectors: the range of their angles to each pivot, and of their lengths."""

    low: np.ndarray
    high: np.ndarray
    short: np.ndarray
    long: np.ndarray

    def most(self, q: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """(queries, groups): what no inner product with a member exceeds, to within rounding."""
        lengths, out = np.linalg.norm(q, axis=1), np.empty((len(q), len(self.low)))
        angles = np.arccos(np.clip(cosines, -1, 1))
        for at in range(0, len(q), 16):
            a = angles[at : at + 16, None, :]
            near = np.cos(np.maximum(np.maximum(self.low - a, a - self.high), 0).max(axis=2))
            out[at : at + 16] = lengths[at : at + 16, None] * (np.maximum(near * self.short, near * self.long) + 1e-7 * self.long)
        return out


def _bounds(cosines: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> Bounds:
    """Of runs of rows that begin at starts."""
    angles = np.arccos(np.clip(cosines, -1, 1))
    return Bounds(np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts), np.minimum.reduceat(lengths, starts), np.maximum.reduceat(lengths, starts))


@dataclass
class Routes:
    """Where things lie: of each pair of first pivots the cell (-1: none) and, of each cell, its first shard and how many it has."""

    pivots: np.ndarray
    cell: np.ndarray
    shard: np.ndarray
    parts: np.ndarray
    bounds: Bounds | None = None

    def home(self, most: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shard that each query begins with: that of the cell of the greatest bound."""
        best = np.nan_to_num(most, nan=np.inf).argmax(axis=1)
        return self.shard[best] + ids % self.parts[best]


def _planned(pivots: np.ndarray, counts: dict[tuple[int, int], int]) -> Routes:
    """Cells of the first pivot, of the first two where there are more than a shard of them; neighbouring cells share a shard while there is room."""
    n = len(pivots)
    cell, shard, parts = np.full((n, n), -1, np.int64), [], []
    by_first: dict[int, int] = {}
    for (a, _), c in counts.items():
        by_first[a] = by_first.get(a, 0) + c
    groups = [([(a, b) for (x, b) in sorted(counts) if x == a], t) for a, t in sorted(by_first.items()) if t <= SHARD]
    groups += [([pair], c) for pair, c in sorted(counts.items()) if by_first[pair[0]] > SHARD]
    at, room = -1, 0
    for number, (pairs, size) in enumerate(groups):
        for a, b in pairs:
            cell[a, b] = number
        if size > SHARD:
            split = -(-size // SHARD)
            shard.append(at + 1)
            parts.append(split)
            at, room = at + split, 0
            continue
        if size > room or at < 0:
            at, room = at + 1, SHARD
        room -= size
        shard.append(at)
        parts.append(1)
    return Routes(pivots, cell, np.array(shard, np.int64), np.array(parts, np.int64))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _posted(pivots: np.ndarray):
    """Entries with their first two pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            first, second = _prefixes(_cosines(_vectors(batch.column("vector")), pivots))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), batch.column("part"), batch.column("vector"), batch.column("ids")], ["first", "second", "part", "vector", "ids"])

    return run


def _measured(routes: Routes):
    """Bounds of the cells, as far as a task has seen them: (cell, pivot, low, high, short, long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in sliced(batches, 4096):
            x = _vectors(batch.column("vector"))
            cells = routes.cell[batch.column("first").to_numpy(), batch.column("second").to_numpy()]
            order = np.argsort(cells, kind="stable")
            cells, x = cells[order], x[order]
            starts = np.flatnonzero(np.diff(cells, prepend=-1))
            b = _bounds(_cosines(x, routes.pivots), np.linalg.norm(x, axis=1), starts)
            for c, *found in zip(cells[starts].tolist(), b.low, b.high, b.short, b.long):
                old = seen.get(c, found)
                seen[c] = [np.minimum(old[0], found[0]), np.maximum(old[1], found[1]), np.minimum(old[2], found[2]), np.maximum(old[3], found[3])]
        for c, (low, high, short, long) in seen.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.arange(n)), pa.array(low), pa.array(high), pa.array(np.full(n, short)), pa.array(np.full(n, long))], ["cell", "pivot", "low", "high", "short", "long"])

    return run


def _listed(batch: pa.RecordBatch, fields: tuple[str, ...], shards: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows (shard, name) with the fields of a batch that is sorted by shards, in lists of ROW_BYTES at most."""
    vectors = batch.column("vector")
    each = max(1, ROW_BYTES * len(vectors) // (8 * len(vectors.flatten())))
    runs = np.flatnonzero(np.diff(shards, prepend=-1))
    place = np.arange(len(shards)) - np.repeat(runs, np.diff(np.append(runs, len(shards))))
    begins = np.flatnonzero(place % each == 0)
    items = pa.StructArray.from_arrays([batch.column(c) for c in fields], list(fields))
    return pa.RecordBatch.from_arrays([pa.array(shards[begins]), pa.ListArray.from_arrays(pa.array(np.append(begins, len(shards)), pa.int32()), items)], ["shard", name])


def _dealt(routes: Routes):
    """Entries in lists by shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            cells = routes.cell[batch.column("first").to_numpy(), batch.column("second").to_numpy()]
            shards = routes.shard[cells] + batch.column("part").to_numpy() % routes.parts[cells]
            order = np.argsort(shards, kind="stable")
            yield _listed(batch.take(pa.array(order)), ("vector", "ids"), shards[order], "block")

    return run


def _sent(routes: Routes, to: range | None):
    """Queries (id, floor, vector) in lists by the shards that they go to: their own (to: None), or those others of to that can reach the floor (queries know their own as home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, fields = routes.shard + routes.parts, ("id", "floor", "vector")
        for batch in sliced(batches, QUERY_BLOCK):
            q = _vectors(batch.column("vector"))
            most = routes.bounds.most(q, _cosines(q, routes.pivots))
            if to is None:
                home = routes.home(most, batch.column("id").to_numpy())
                order = np.argsort(home, kind="stable")
                yield _listed(batch.take(pa.array(order)), fields, home[order], "queries")
                continue
            home, floors = batch.column("home").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False)
            reach = ~(most < floors[:, None])  # what overflows is searched
            for s in to:
                cells = (routes.shard <= s) & (s < ends)
                rows = np.flatnonzero(reach[:, cells].any(axis=1) & (home != s))
                if len(rows):
                    yield _listed(batch.take(pa.array(rows)), fields, np.full(len(rows), s), "queries")

    return run


class _Shard:
    """A shard's entries, sorted by nearest pivot, with the inverted files and the bounds of its own cells."""

    def __init__(self, block: pa.Array, pivots: np.ndarray, posted: int):
        x, ids = _vectors(block.field("vector")), block.field("ids").to_pylist()
        cosines = _cosines(x, pivots)
        order = np.argsort(cosines.argmax(axis=1), kind="stable")
        self.x, self.ids, cosines = x[order], [ids[c] for c in order], cosines[order]
        self.starts = np.flatnonzero(np.diff(cosines.argmax(axis=1), prepend=-1))
        self.ends = [*self.starts[1:].tolist(), len(x)]
        self.bounds = _bounds(cosines, np.linalg.norm(self.x, axis=1), self.starts)
        self.files = np.ascontiguousarray(_permutations(cosines, posted).T)

    def guessed(self, q: np.ndarray, ranks: np.ndarray, posted: int, want: int, least: int) -> np.ndarray:
        """Of each query the least-th best inner product among the want entries nearest by footrule."""
        out = np.empty(len(q))
        for i, own in enumerate(ranks):
            asks = np.flatnonzero(own < posted)
            far = np.abs(self.files[asks] - own[asks, None]).sum(axis=0, dtype=np.int32)
            near = np.argpartition(far, want - 1)[:want] if want < len(far) else np.arange(len(far))
            score = self.x[near] @ q[i]
            out[i] = np.partition(score, len(score) - least)[len(score) - least]
        return out

    def hits(self, q: np.ndarray, own: np.ndarray, floors: np.ndarray, most: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """Of each query its k best here, of those whose inner product is at least its floor."""
        score = np.full((len(q), len(self.x)), -np.inf)
        for cell, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            asks = np.flatnonzero(~(most[:, cell] < floors))
            if len(asks):
                score[asks, a:b] = q[asks] @ self.x[a:b].T
        slack = floors - 1e-7 * np.abs(floors)
        for i in range(len(q)):
            some = np.flatnonzero(~(score[i] < slack[i]))
            if len(some) > k + 1:
                # one entry may hold the query itself
                cut = np.partition(score[i][some], len(some) - k - 1)[len(some) - k - 1]
                some = some[~(score[i][some] < cut - 1e-7 * abs(cut))]
            exact = np.einsum("d,cd->c", q[i], self.x[some])
            found = [(-s, v) for s, c in zip(exact.tolist(), some.tolist(), strict=True) for v in self.ids[c] if v != own[i]]
            for s, v in sorted(found)[:k]:
                yield int(own[i]), v, -s


def _search(pivots: np.ndarray, posted: int, rerank: int, k: int):
    """Of rows (shard, queries, block), of each shard its entries and then its queries, the k best hits of each query in the shard; without a floor, from a guess by footrule."""

    def found(shard: _Shard, s: pa.StructArray) -> Iterator[tuple[int, int, float]]:
        ids, q, floors = s.field("id").to_numpy(), _vectors(s.field("vector")), s.field("floor").to_numpy(zero_copy_only=False)
        cosines = _cosines(q, pivots)
        most, n = shard.bounds.most(q, cosines), len(shard.x)
        for at in range(0, len(q), 64):
            part = slice(at, at + 64)
            floor = floors[part]
            if np.isnan(floor).any():
                guess = shard.guessed(q[part], _permutations(cosines[part], posted), posted, min(n, max(rerank, 2 * (k + 1))), min(n, k + 1))
                floor = np.where(np.isnan(floor), guess, floor)
            yield from shard.hits(q[part], ids[part], floor, most[part], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, shard = -1, [], None
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("queries").is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(2 * numbers + asks, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if numbers[a] != held:
                    held, blocks, shard = numbers[a], [], None
                if not asks[a]:
                    blocks.append(batch.column("block").slice(a, b - a).flatten())
                    continue
                if blocks:
                    blocks, shard = [], _Shard(pa.concat_arrays(blocks), pivots, posted)
                if shard is None:  # a shard that no entry fell to
                    continue
                hits = list(found(shard, batch.column("queries").slice(a, b - a).flatten()))
                columns = zip(*hits, strict=True) if hits else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """count rows of x, farthest first by angle, from the first on."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(count, len(x)):
        near[chosen[-1]] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return x[chosen]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: with an id, and a vector of the commonest length without null or non-finite components that isn't zero. Of rows with one id, the smallest vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["d"] if sizes else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def index(entries: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, Routes]:
    """(shards (shard, block), routes) of entries (vector, ids): every entry lies in one shard, which is some rows."""
    part = F.pmod(F.xxhash64("vector"), F.lit(1 << 40)).alias("part")
    posted = materialize(entries.select(part, "vector", "ids").mapInArrow(_posted(pivots), "first long, second long, part long, vector array<double>, ids array<long>"), "posted", 4096)
    counts = {(r["first"], r["second"]): r["n"] for r in posted.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).collect()}
    routes = _planned(pivots, counts)
    n = len(pivots)
    with arrow_batches(entries.sparkSession, 4096):
        seen = posted.select("first", "second", "vector").mapInArrow(_measured(routes), "cell long, pivot long, low double, high double, short double, long double")
        got = seen.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short"), F.max("long").alias("long")).orderBy("cell", "pivot").toArrow()
    low, high, short, long = (np.array(got[c].to_pylist(), float).reshape(-1, n) for c in ("low", "high", "short", "long"))
    routes.bounds = Bounds(low, high, short[:, 0], long[:, 0])
    shards = materialize(posted.mapInArrow(_dealt(routes), DEALT), "shards", 4096)
    discard(posted)
    return shards, routes


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, pivots: int = 64, posted: int = 16, rerank: int = 400) -> DataFrame:
    """The k nearest of each query (rows whose id is divisible by every): (query_id, rank, vec_id, score).

    Nearness is the largest inner product in double precision, of vectors of any length (cells know their lengths), ties go to
    the smaller id, a query doesn't find its own id. pivots: how many are taken, farthest first, from a documented sample (the
    SPREAD * pivots distinct vectors of smallest hash); posted: pivots in a vector's prefix; rerank: entries of its first shard
    that a query reranks for its floor. The last two bear on the cost and not on the result. Rows that cannot take part (see
    usable) are neither queries nor candidates: nulls, zeros, vectors of a length other than the commonest, and of repeated rows
    of one id all but the smallest vector; other columns are ignored; fewer candidates than k are all returned; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    # of equal vectors, no query returns more than the k + 1 smallest ids
    alike = Window.partitionBy("vector").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "entries")
    # equal vectors are one entry, so copies cannot crowd the pivots
    sample = [r["vector"] for r in entries.orderBy(F.xxhash64("vector"), "vector").limit(SPREAD * pivots).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    p = _spread(np.array(sample, np.float64), pivots)
    shards, routes = index(entries, p)
    count = int((routes.shard + routes.parts).max())
    search = _search(p, min(posted, len(p)), rerank, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(sent: DataFrame, to: range, name: str) -> DataFrame:
        # the stated query set against the shards: of each, its entries come before its queries
        blocks = shards.where(F.col("shard").between(to.start, to.stop - 1)).select("shard", F.lit(None).cast(QUERIES).alias("queries"), "block")
        both = blocks.unionByName(sent.select("shard", "queries", F.lit(None).cast(BLOCK).alias("block")))
        both = both.repartition(min(4 * len(to), 10_000), "shard").sortWithinPartitions("shard", F.col("queries").isNotNull())
        return materialize(both.mapInArrow(search, HITS), name, 256)

    asked = rows.where(F.col("id") % every == 0).select("id", F.lit(None).cast("double").alias("floor"), "vector")
    homes = materialize(asked.mapInArrow(_sent(routes, None), ASKED), "home-asked", QUERY_BLOCK)
    top = met(homes, range(count), "home")
    asked = homes.select(F.col("shard").alias("home"), F.explode("queries").alias("q")).select("home", "q.id", "q.vector")
    weight = asked.count() * 8 * p.shape[1]
    step = max(1, min(count, ROUND_BYTES // max(weight, 1)))
    spent: list[DataFrame] = []
    for at in range(0, count, step):
        discard(*spent)
        to = range(at, min(at + step, count))
        least = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        # fewer hits than k are no floor
        floors = asked.join(least, "id", "left").select("id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "vector", "home")
        sent = materialize(floors.mapInArrow(_sent(routes, to), ASKED), "others-asked", QUERY_BLOCK)
        rest = met(sent, to, "others")
        ranked = top.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if to.stop < count:
            spent = [top, sent, rest]
            top = materialize(ranked.select("query_id", "vec_id", "score"), "top")
    return ranked.select("query_id", "rank", "vec_id", "score")
