"""Shared plumbing: scratch tables in the cluster's shared folder, table reading, bounded Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_LOCAL: list[str] = []
#: Paths of the tables in the shared folder that are not deleted yet, in order.
_TABLES: list[str] = []
#: Rows of an Arrow batch that a kernel turns into Python objects at once, at most.
SLICE = 256


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="corpusloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = "file://" + _LOCAL[0]
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage is cut and a lost executor costs no recomputation. rows: bound on the rows of an Arrow batch meanwhile."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/corpusloom-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    with arrow_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _TABLES:
        _TABLES.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_corpusloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def materialized_alone(df_of, name: str, spark: SparkSession, *spent: DataFrame) -> DataFrame:
    """The table of df_of(), written; then every other table that was written for it is deleted, and so are the spent ones."""
    before = set(_TABLES)
    out = materialize(df_of(), name)
    for path in [p for p in _TABLES if p not in before and p != out._corpusloom_path]:
        _delete(spark, path)
    discard(*spent)
    return out


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every table this process has put into the shared folder. Call it once the results are written."""
    _delete(spark, f"{shared_root(spark)}/corpusloom-{_RUN}")
    _TABLES.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Bounds what one Arrow batch holds in the jobs of this block, and puts the session's settings back: texts differ in length by four orders of magnitude. None changes nothing."""
    wanted = {} if rows is None else {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, none empty: a kernel's memory doesn't hang on the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text ends its run."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > most:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: what an operator adds beside it can't clash with them."""
    return F.struct(*[quoted(c) for c in df.columns])


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with leading underscores for as long as a taken column has it (case is ignored)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def take_kept(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that a deduplication keeps, with all their columns, of whatever names.

    labelled: (id_col, text_sha256, kept), a row for each row of docs. The texts are not shuffled while the dropped rows are few
    enough to broadcast. The digest only tells rows of one id apart. Of repeated rows of which one is kept, one is taken.
    """
    from .components import bounded

    marked = labelled.select(F.col(id_col).alias("i"), F.col("text_sha256").alias("h"), "kept")
    rows = marked.where("not kept").select("i", "h").distinct()
    again = marked.where("kept").alias("k").join(rows.alias("r"), F.expr("k.i <=> r.i and k.h = r.h"), "left_semi").select("i", "h")
    marks = rows.withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False)))
    marks = materialize(marks.groupBy("i", "h").agg(F.min("gone").alias("gone")), "marks")
    named = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("own"), F.sha2(text_or_empty(text_col), 256).alias("sha"))
    met = F.expr("own <=> i and sha = h")
    out = named.join(bounded(marks, 200_000), met, "left_anti").select("row")
    once = marks.where("not gone")
    if not once.isEmpty():
        repeated = named.join(bounded(once, 200_000), met, "left_semi").dropDuplicates(["own", "sha"])
        out = out.unionByName(repeated.select("row"))
    return out.select("row.*")
