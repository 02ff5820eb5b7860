"""Near-duplicate classes by BagMinHash: sketch, band, verify on the multisets of word shingles, and connect.

Equal texts are one node from the start. Within a bucket no pairs are listed:

1. Each member is compared with one leader, first by signature, then exactly, and linked to it if similar.
2. Where the components so far still divide a bucket, its members outside the leader's component are compared with all the
   others, block by block: a row holds two bounded blocks of signatures, and only pairs of different components whose signatures
   agree come out of it, the most similar first. They are verified as well, and the components joined, before less similar ones
   are looked at; the last round takes all that are left. So no link that could join two components is lost, however large the bucket.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import bounded, connected_components
from .common import discard, grouped, materialize, sliced, text_or_empty

#: A link at the threshold is missed with a probability of (1 - 0.8 ** 5) ** 25 = 5e-5.
COMPONENTS, BANDS, ROWS = 512, 25, 5
#: Signatures that agree less are not verified: four standard deviations (sqrt(0.8 * 0.2 / 512)) below the threshold.
LEAST_AGREEMENT = 0.07
#: Members of a block, about, and outer blocks of one bucket that one task compares with all the others.
BLOCK, SPAN = 500, 64
#: Best partners in each block that a member offers, round by round; the last round takes all that are still in other components.
BEST = (4, None)
#: Characters that one call of the kernels takes, about.
GROUP_CHARS = 600_000


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bagminhash as bag

        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for run_of in grouped(texts, GROUP_CHARS):
                part = texts[run_of]
                keys = [hashlib.sha256(t.encode()).digest() for t in part]
                first = {key: i for i, key in reversed(list(enumerate(keys)))}
                own = sorted(first.values())
                sig, total = bag.signatures([part[i] for i in own], COMPONENTS, k)
                rows = bag.bands(sig, BANDS, ROWS).tolist()
                # of each component a byte is kept
                low = bag.mix(sig.astype(np.float32).view(np.uint32).astype(np.uint64)).astype(np.uint8)
                found = {keys[i]: (r if n else [], s.tobytes()) for i, r, n, s in zip(own, rows, total.tolist(), low, strict=True)}
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(run_of.start, len(part)), pa.array(keys, pa.binary()), pa.array([found[key][0] for key in keys], pa.list_(pa.int64())), pa.array([found[key][1] for key in keys], pa.binary())], ["id", "key", "bands", "sketch"])

    return run


def _verify(k: int):
    """sim of each pair (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bagminhash as bag

        kept: OrderedDict = OrderedDict()

        def sets(ids: list[int], texts: list[str]) -> list:
            new = {i: t for i, t in zip(ids, texts, strict=True) if i not in kept}
            got = dict(zip(new, bag.multisets(list(new.values()), k), strict=True)) if new else {}
            out = [got[i] if i in got else kept[i] for i in ids]
            kept.update(list(got.items())[-50:])
            while len(kept) > 100:
                kept.popitem(last=False)
            return out

        for batch in sliced(batches, 64):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left = sets(a, batch.column("text_a").to_pylist())
            right = sets(b, batch.column("text_b").to_pylist())
            sims = [bag.similarity(x, y) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sims, pa.float64())})

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures of one byte a component; other bytes agree by chance once in 256."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _agreeing(least: float):
    """Of rows (a, b, sketch_a, sketch_b), the pairs (a, b) whose signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                ok = pa.array(_agreement(x, y) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def _across(least: float, most: int | None):
    """Of rows (bucket, outer, block), lists of (node, comp, sketch, bands), the pairs of different components whose signatures agree, at most so many of the best for each outer node. A pair comes out of the first bucket that it shares, and of no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(rows: pa.Array):
            s = rows.flatten()
            n, c = s.field("node").to_numpy(), s.field("comp").to_numpy()
            bands = s.field("bands").flatten().to_numpy().reshape(len(n), -1)
            return n, c, np.frombuffer(b"".join(s.field("sketch").to_pylist()), np.uint8).reshape(len(n), -1), bands

        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column("bucket")[k].as_py()
                (n, c, x, own), (m, d, y, other) = (read(batch.column(col).slice(k, 1)) for col in ("outer", "block"))
                a, b, cut = [], [], False
                for i in range(len(n)):
                    alike = _agreement(x[i], y)
                    hit = np.flatnonzero((alike >= least) & (d != c[i]))
                    hit = hit[own[i][(other[hit] == own[i]).argmax(axis=1)] == bucket] if len(hit) else hit
                    if most is not None and len(hit) > most:
                        hit, cut = hit[np.argsort(-alike[hit], kind="stable")[:most]], True
                    a.append(np.minimum(n[i], m[hit]))
                    b.append(np.maximum(n[i], m[hit]))
                x, y = np.concatenate(b), np.concatenate(a)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), cut))], ["a", "b", "cut"])

    return run


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar. The texts of these nodes alone are gathered; the hub that a bucket's members share is on the side that an adaptive join can split."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = bounded(materialize(named.join(nodes.select("node", "key"), "node").select("node", "key"), "wanted"), 200_000)
    texts = source.select(F.unhex(F.sha2("text", 256)).alias("key"), "text").join(wanted, "key").select("node", "text")
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    rated = whole.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k), "a long, b long, sim double")
    links = materialize(rated.where(F.col("sim") >= threshold).select("a", "b"), "links", 100)
    discard(texts)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row for each row of docs: (id_col, class_id, class_size, kept, text_sha256).

    Words are runs of letters and digits (ASCII) and of characters beyond ASCII, in lower case. Two texts are linked if the
    weighted Jaccard similarity of their multisets of word shingles is at least threshold; classes are the connected components;
    class_id is the smallest id in it and kept marks one row of it, with that id. Equal texts are always one class, texts
    without words (null counts as empty) link to nothing else; a text of fewer words than a shingle is one shingle. A null id
    is larger than any other; of repeated rows exactly one is kept; texts of any length are read whole; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = materialize(source.mapInArrow(_sketch(shingle), f"id {kind}, key binary, bands array<long>, sketch binary").withColumn("uid", F.monotonically_increasing_id()), "sketches", 1000)
    nodes = materialize(rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = materialize(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1"), "buckets")
    members = materialize(placed.join(bounded(buckets), "bucket").select("bucket", "node", "n", "leader"), "members")
    least = threshold - LEAST_AGREEMENT
    sketches = nodes.select("node", "sketch")
    both = nodes.select("node", "sketch", "bands")

    pairs = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    compared = materialize(pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreeing(least), "a long, b long"), "compared", 1000)
    links = _verified(compared, source, nodes, threshold, shingle)

    comps = bounded(connected_components(links))
    for most in BEST:
        named = members.where("n > 2").join(comps, "node", "left").join(comps.select(F.col("node").alias("leader"), F.col("comp").alias("lead")), "leader", "left")
        named = materialize(named.select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("lead", "leader").alias("lead")), "named")
        # a bucket of two has been compared in full
        divided = named.groupBy("bucket").agg(F.max(F.col("comp") != F.col("lead")).alias("open")).where("open").select("bucket")
        rest = named.join(bounded(materialize(divided, "divided")), "bucket").join(both, "node")
        rest = rest.withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        rest = materialize(rest.select("bucket", "part", "parts", F.struct("node", "comp", "sketch", "bands").alias("m"), (F.col("comp") != F.col("lead")).alias("outside")), "rest")
        # a bucket is dealt over a task for every SPAN of its outer blocks; its other blocks are copied to each of these
        salts = F.ceil(F.col("parts") / SPAN)
        outer = rest.where("outside").groupBy("bucket", "part", "parts").agg(F.collect_list("m").alias("outer")).select("bucket", F.pmod("part", salts).alias("salt"), "outer")
        blocks = rest.groupBy("bucket", "part", "parts").agg(F.collect_list("m").alias("block")).select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "block")
        found = outer.join(blocks, ["bucket", "salt"]).select("bucket", "outer", "block").mapInArrow(_across(least, most), "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))
        # a row holds two blocks, about 700 kB
        found = materialize(found, "found", 4)
        cut = found.agg(F.max("cut")).first()[0]
        more = materialize(found.join(compared, ["a", "b"], "left_anti").select("a", "b"), "more")
        compared = compared.unionByName(more)
        links = links.unionByName(_verified(more, source, nodes, threshold, shingle))
        comps = bounded(connected_components(links))
        if not cut:
            break

    grouped = nodes.join(comps, "node", "left").select("key", "node", "id", "copies", F.coalesce("comp", "node").alias("comp"))
    classes = grouped.groupBy("comp").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    several = materialize(grouped.join(classes.where("class_size > 1"), "comp").select("key", "comp", "class_id", "class_size"), "classes")
    out = rows.select("id", "key", "uid").join(bounded(several, 200_000), "key", "left")
    out = materialize(out.select("id", "uid", "key", "comp", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")), "rows")
    won = out.where("class_size > 1 and id <=> class_id").groupBy("comp").agg(F.min("uid").alias("uid"))
    won = bounded(materialize(won.select("uid", F.lit(True).alias("won")), "won"))
    shape = (F.col("id").alias(id_col), "class_id", "class_size")
    sha = F.lower(F.hex("key")).alias("text_sha256")
    single = out.where("class_size = 1").select(*shape, F.lit(True).alias("kept"), sha)
    return single.unionByName(out.where("class_size > 1").join(won, "uid", "left").select(*shape, F.coalesce("won", F.lit(False)).alias("kept"), sha))
