"""SentencePiece encoding and decoding of a text column, by batched Viterbi segmentation in the Python workers (see viterbi)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, grouped, quoted, sliced, text_or_empty

#: Characters that are segmented, and handed back, at once.
GROUP_CHARS = 500_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows and their texts, which are the last column, in groups of about GROUP_CHARS."""
    for batch in sliced(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for part in grouped(texts, GROUP_CHARS):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and where each text's begin and the last ends."""
    return np.concatenate(ids) if ids else np.empty(0, np.int32), np.cumsum([0, *map(len, ids)]).astype(np.int32)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import viterbi

        model = viterbi.load(path)
        for rows, texts in _groups(batches):
            values, ends = _flat(model.encode(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))], [*rows.schema.names[:-1], "ids"])

    return run


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import viterbi

        model = viterbi.load(path)
        for rows, texts in _groups(batches):
            values, ends = _flat(model.encode(texts))
            back = model.decode(values, ends[1:])
            exact = [t.replace(viterbi.SPACE, " ") == b for t, b in zip(texts, back, strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ends), pa.int64()), ids, pa.array(exact, pa.bool_())], ["id", "n_pieces", "ids", "exact"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import viterbi

        model = viterbi.load(path)
        for part in sliced(batches, 100):
            ids = part.column(part.num_columns - 1)
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            texts = model.decode(values, offsets[1:] - offsets[0])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(texts, pa.string())], [*part.schema.names[:-1], "ids", "decoded"])

    return run


def _kept(df: DataFrame, keep: list[str], last) -> DataFrame:
    """The columns keep under numbers, and a last one."""
    return df.select(*[quoted(c).alias(f"k{k}") for k, c in enumerate(keep)], last)


def _handed(out: DataFrame, keep: list[str], *results: str) -> DataFrame:
    names = free_names(keep, *results)
    return out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], *[F.col(r).alias(n) for r, n in zip(results, names, strict=True)])


def _schema(rows: DataFrame, results: str) -> T.StructType:
    return T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(results).fields])


def encode(docs: DataFrame, model: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and ids array<int>, a row for each row of docs.

    model: path of the model file, readable on every executor. A null or empty text has no ids; a text of any length is segmented
    whole, word by word; nulls in kept columns stay; other columns are ignored, and a result whose name a kept column has takes
    leading underscores; repeated rows each keep their row; an empty table gives an empty result; there are no begin or end
    pieces. Of paths of equal score (ties) the library's is taken.
    """
    rows = _kept(docs, keep, text_or_empty(text_col).alias("t"))
    return _handed(rows.mapInArrow(_encode(model), _schema(rows, "ids array<int>")), keep, "ids")


def decode(encoded: DataFrame, model: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns keep, ids and decoded. The text comes back as it was, but for U+2581, which the model writes for spaces. Null and empty ids give an empty text; names, repeated rows and empty tables are taken as by encode()."""
    rows = _kept(encoded, keep, F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("t"))
    return _handed(rows.mapInArrow(_decode(model), _schema(rows, "ids array<int>, decoded string")), keep, "ids", "decoded")


def encoded_and_checked(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids, exact): the pieces of every whole text, and whether decoding them gives it back.

    Both ways are gone in one pass, so that a task holds one worker and one model, and no ids travel twice. Texts, ids and rows
    are taken as by encode() and decode().
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(_round_trip(model), _schema(rows, "n_pieces long, ids array<int>, exact boolean")).withColumnRenamed("id", id_col)
