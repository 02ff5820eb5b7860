"""Quality classifier by co-training of a text view and a metadata view.

Each view has a logistic classifier of its own: one reads what the text looks like and which words it holds, the other language,
source and length. In each round both score every unlabelled document, in a distributed pass, and each hands the documents of the
whole pool that it is surest of to the other, with its own label. Both are calibrated on labelled documents that were held out,
and their log-odds are added above the prior to score every document.

Two parameters bound what the driver fits on, whatever the size of the corpus: ``sample`` labelled documents, and for each of them
``each`` documents that a view hands over in a round. The pool they are taken from has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, discard, free_names, grouped, materialize, quoted, sliced, text_or_empty, whole_row
from .components import bounded

#: Word buckets, kinds of bytes, buckets of languages and of sources.
WORDS, CLASSES, LANGS, SOURCES = 512, 16, 64, 1024
META, TEXT = LANGS + SOURCES + 3, CLASSES * CLASSES + WORDS + 3
#: Labelled ids that are broadcast at most.
FEW_LABELS = 200_000
#: Characters that are turned into features at once, about.
GROUP_CHARS = 500_000
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"#%&$*", b"<>/\\{}[]()=", b"'\"-_"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 15


def text_features(texts: list[str]) -> np.ndarray:
    """What texts look like: shares of pairs of byte classes, of word buckets, of distinct words, and length."""
    from . import bagminhash as bag

    out = np.zeros((len(texts), TEXT), np.float32)
    hashes, owner = bag.words(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    bucket = (hashes & np.uint64(WORDS - 1)).astype(np.int64)
    at = CLASSES * CLASSES
    counts = np.bincount(owner * WORDS + bucket, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    out[:, at : at + WORDS] = np.sqrt(counts / np.maximum(n_words, 1)[:, None])
    distinct = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    kinds = np.bincount((distinct >> np.uint64(44)).astype(np.int64), minlength=len(texts))
    out[:, -3] = kinds / np.maximum(n_words, 1)
    out[:, -2] = np.log1p(n_words) / 10
    for i, t in enumerate(texts):
        c = _CLASS[np.frombuffer(t.encode(), np.uint8)]
        if len(c) > 1:
            out[i, :at] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=at) / (len(c) - 1))
    out[:, -1] = 1
    return out


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Buckets of language and, apart from them, of source, and length."""
    import zlib

    out = np.zeros((len(langs), META), np.float32)
    for i, (lang, source, n) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, zlib.crc32(f"lang {lang}".encode()) % LANGS] = 1
        out[i, LANGS + zlib.crc32(f"source {source}".encode()) % SOURCES] = 1
        size = np.log1p(max(n or 0, 0)) / 10
        out[i, -3:-1] = size, size * size
    out[:, -1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression, by Adam on the whole sample."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= np.float32(0.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + np.float32(1e-8))
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that the log-odds are a * z + b."""
    w = fit(np.stack([z / 5, np.ones(len(z))], axis=1), y, 1e-3, 400)
    return max(float(w[0] / 5), 0.0), float(w[1])


@dataclass
class Model:
    """Weights of both views, their calibrations, and the prior log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        a = self.text_scale[0] * (xt @ self.text) + self.text_scale[1]
        b = self.meta_scale[0] * (xm @ self.meta) + self.meta_scale[1]
        return np.stack([1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, a + b - self.prior)], axis=1).astype(np.float64)


def held_out(y: np.ndarray) -> np.ndarray:
    """Every fifth labelled row (they stand by class), for calibration; none if a class would be missing on either side."""
    held = np.arange(len(y)) % 5 == 0
    return held if 0 < y[held].mean() < 1 and 0 < y[~held].mean() < 1 else np.zeros(len(y), bool)


@dataclass
class Handed:
    """Pseudo-labelled rows that a view has been given: features and labels."""

    x: list
    y: list

    def fitted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return fit(np.concatenate([x, *self.x]), np.concatenate([y, *self.y]))


def finished(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, views: list[np.ndarray]) -> Model:
    """The model of two fitted views, calibrated on the rows held out."""
    held = held_out(y)
    check = held if held.any() else np.ones(len(y), bool)
    scales = [calibrate(x[check] @ w, y[check].astype(float)) for x, w in ((xt, views[0]), (xm, views[1]))]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return Model(views[0], views[1], scales[0], scales[1], float(np.log(share / (1 - share))))


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column("text").to_pylist()
        xt = np.concatenate([text_features(texts[part]) for part in grouped(texts, GROUP_CHARS)]).astype(np.float16)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([r.tobytes() for r in xt], pa.binary())], [*names, "xt"])


def _featured(rows: DataFrame) -> DataFrame:
    """rows (..., text, lang, source, size) with xt, the text's features, instead of the text."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(_text_features, ", ".join([*fields, "xt binary"]))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), TEXT).astype(np.float32)


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    return meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "size")))


def _rated(views: list[np.ndarray]):
    """The log-odds that each view gives the documents of the pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            z = _unpacked(batch.column("xt")) @ views[0], _metadata(batch) @ views[1]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("tie"), *(pa.array(x.astype(float), pa.float64()) for x in z)], ["uid", "tie", "z0", "z1"])

    return run


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Both views of rows (xt, lang, source, size, ...), of which there are few, on the driver."""
    with arrow_batches(rows.sparkSession, 1000):
        got = rows.toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros((0, TEXT), np.float32), np.zeros((0, META), np.float32), got
    batch = got.to_batches()[0] if got.num_rows else None
    return _unpacked(batch.column("xt")), _metadata(batch), got


def _surest(rated: DataFrame, z: str, most: int, least: float) -> DataFrame:
    """uid of the most rows of greatest z, of at least ``least``, ties by the hash of the id. A histogram finds the value from which on rows are sorted, so that no task sorts more than these."""
    rows = rated.where(F.col(z) >= least)
    step = F.floor(F.col(z) * 16)
    held, edge = 0, None
    for s, n in sorted(((r["s"], r["n"]) for r in rows.groupBy(F.least(step, F.lit(16_000)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        held, edge = held + n, s
        if held >= most:
            break
    return rows.where(F.lit(False) if edge is None else F.least(step, F.lit(16_000)) >= edge).orderBy(F.desc(z), "tie", "uid").limit(most).select("uid")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 5000, rounds: int = 3, each: float = 0.05, sure: float = 0.95) -> Model | None:
    """The model, or None if the labels don't hold both classes.

    The pool is every document without any label, so the labelled ones held out for calibration are in no part of the training.
    In a round each view hands over, for each labelled document that is fitted on, ``each`` documents: those of the whole pool
    that it is surest of, and at least ``sure`` of, by class in the labels' proportions; none is handed to a view twice. sample: labelled ids that are fitted on at most, those of
    smallest hash. Conflicting labels of one id are averaged; null ids and labels are left out; where scores are equal (ties) the
    smaller hash of the id goes first.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    marks = materialize(marks, "labels")
    tie = F.xxhash64(F.lit("sample"), "id")
    views = docs.select(quoted(id_col).alias("id"), text_or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("size"))
    # the sample is bounded, whatever the size of the labels
    chosen = marks.orderBy(tie, "id").limit(sample)
    xt, xm, known = _collected(_featured(views.join(F.broadcast(chosen), "id").withColumn("tie", tie).select("tie", "y", "text", "lang", "source", "size")))
    y = np.array(known["y"].to_pylist(), float)
    if not len(y) or len(np.unique(y)) < 2:
        return None
    # rows come in any order; by class first, so that a fifth of each is held out
    order = np.lexsort((xm[:, -3], np.array(known["tie"].to_pylist(), np.int64), y))
    xt, xm, y = xt[order], xm[order], y[order]

    pool = views.join(bounded(marks.select("id"), FEW_LABELS), "id", "left_anti").withColumn("tie", tie)
    pool = materialize(_featured(pool.select("tie", "text", "lang", "source", "size")).withColumn("uid", F.monotonically_increasing_id()), "pool", 1000)
    held = held_out(y)
    quota = each * (~held).sum()
    base, given, gone = y[~held].mean(), [Handed([], []), Handed([], [])], [np.empty(0, np.int64), np.empty(0, np.int64)]
    fitted = lambda: [given[k].fitted(x[~held], y[~held]) for k, x in enumerate((xt, xm))]
    weights = fitted()
    for _ in range(rounds if not pool.isEmpty() else 0):
        rated = materialize(pool.select("uid", "tie", "xt", "lang", "source", "size").mapInArrow(_rated(weights), "uid long, tie long, z0 double, z1 double"), "rated", 1000)
        least = float(np.log(sure / (1 - sure)))
        for k, z in enumerate(("z0", "z1")):
            other = 1 - k
            # what the other view has been given already, a few times the quota at most
            spent = docs.sparkSession.createDataFrame([(int(u),) for u in gone[other]], "uid long")
            fresh = rated.join(F.broadcast(spent), "uid", "left_anti")
            for label, part, sign in ((1.0, base, F.col(z)), (0.0, 1 - base, -F.col(z))):
                most = int(quota * part)
                if not most:
                    continue
                best = _surest(fresh.select("uid", "tie", sign.alias("z")), "z", most, least)
                pt, pm, rows = _collected(pool.join(F.broadcast(best), "uid"))
                if rows.num_rows:
                    sort = np.argsort(np.array(rows["uid"].to_pylist(), np.int64))
                    given[other].x.append((pt, pm)[other][sort])
                    given[other].y.append(np.full(rows.num_rows, label))
                    gone[other] = np.append(gone[other], np.array(rows["uid"].to_pylist(), np.int64))
        discard(rated)
        weights = fitted()
    discard(pool)
    return finished(xt, xm, y, weights)


def _scoring(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if model is None:
                p = np.ones((batch.num_rows, 3))
            else:
                texts = batch.column("text").to_pylist()
                xt = np.concatenate([text_features(texts[part]) for part in grouped(texts, GROUP_CHARS)])
                p = model.score(xt, _metadata(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(p[:, k]) for k in range(3))], ["row", "p_text", "p_meta", "p_quality"])

    return run


def _scored(docs: DataFrame, model: Model | None, row) -> DataFrame:
    rows = docs.select(row.alias("row"), text_or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("size"))
    return rows.mapInArrow(_scoring(model), T.StructType([rows.schema["row"], *T.StructType.fromDDL("p_text double, p_meta double, p_quality double").fields]))


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep, p_text, p_meta and p_quality for every row of docs.

    A null text is empty, a text of any length is read whole, null metadata are a value of their own; without a model every
    score is 1; repeated rows each keep their row and score alike; other columns are ignored, and a result whose name a kept
    column has takes leading underscores; an empty table gives an empty result.
    """
    out = _scored(docs, model, F.struct(*[quoted(c) for c in keep]))
    results = ("p_text", "p_meta", "p_quality")
    return out.select("row.*", *[F.col(r).alias(n) for r, n in zip(results, free_names(keep, *results), strict=True)])


def passing(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs that score at least ``least``, with just their columns."""
    return _scored(docs, model, whole_row(docs)).where(F.col("p_quality") >= least).select("row.*")


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", least: float = 0.3) -> DataFrame:
    """(id_col, p_text, p_meta, p_quality, keep) of every row of docs, by a model trained on labels; keep: the score is at least ``least``."""
    return score(docs, train(docs, labels, id_col), [id_col]).withColumn("keep", F.col("p_quality") >= least)
