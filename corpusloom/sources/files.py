"""Readers and writers of corpora: text and PDF folders, JSON records, Parquet caches, and where they live."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name

GENRES = ("novels", "novellas", "short_stories")
#: The folders of a corpus, by what they hold and its type.
FOLDERS = {
    "texts": {"cleaned": "cleaned_texts", "corpus": "corpus_analytics", "window": "window_metrics"},
    "embeddings": {"concept": "concept_embeddings", "passage": "passage_embeddings"},
    "graphs": {"network": "network_analysis", "syntactic": "syntactic_graphs"},
}


@dataclass(frozen=True)
class Layout:
    """Paths of a corpus's layers under one root, on any file system that Spark reads."""

    root: str

    def _joined(self, *parts: str | None) -> str:
        return "/".join([self.root.rstrip("/"), *[p for p in parts if p]])

    def raw(self, category: str | None = None) -> str:
        return self._joined("raw_texts", category)

    def path(self, layer: str, kind: str, subfolder: str | None = None, filename: str | None = None) -> str:
        """The folder, or a file in it, of a layer (texts, embeddings, graphs) and a type of it."""
        if layer not in FOLDERS:
            raise ValueError(f"unknown layer {layer!r}; known: {', '.join(FOLDERS)}")
        if kind not in FOLDERS[layer]:
            raise ValueError(f"unknown type {kind!r} of {layer}; known: {', '.join(FOLDERS[layer])}")
        return self._joined(layer, FOLDERS[layer][kind], subfolder, filename)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(genre, book, name, text) of the *.txt files below folder, a whole file each; name has neither folders, suffix nor the mark of cleaned texts."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -3).alias("genre"), F.element_at(parts, -2).alias("book"), base_name(F.col("path")).alias("name"), F.col("value").alias("text"))


def list_pdfs(spark: SparkSession, folder: str, genres: tuple[str, ...] = GENRES) -> DataFrame:
    """(genre, name, path, content) of the *.pdf files in the genres' folders; a genre without a folder has none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    genre = F.element_at(F.split("path", "/"), -2)
    return rows.select(genre.alias("genre"), F.lower(base_name(F.col("path"))).alias("name"), "path", "content").where(genre.isin(*genres))


def pdf_reader() -> Callable[[bytes], list[str]]:
    """The reader that an installed library gives: from a file's bytes to its pages' texts."""
    import io

    try:
        import pdfplumber
    except ImportError:
        try:
            import pypdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pdfplumber or pypdf, or a reader of your own") from e
        return lambda data: [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages]

    def read(data: bytes) -> list[str]:
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]

    return read


def read_pdf_pages(pdfs: DataFrame, load: Callable[[], Callable[[bytes], list[str]]]) -> DataFrame:
    """(genre, name, page_no, page_text), pages from 1. load() makes, once in each Python worker, the function from a file's bytes to its pages' texts."""

    def run(batches):
        import pandas as pd

        read = load()
        for pdf in batches:
            rows = [(g, n, k, t) for g, n, c in zip(pdf["genre"], pdf["name"], pdf["content"], strict=True) for k, t in enumerate(read(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["genre", "name", "page_no", "page_text"])

    return pdfs.select("genre", "name", "content").mapInPandas(run, "genre string, name string, page_no int, page_text string")


def pages_to_text(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(genre, name, text): the pages of each file joined by line ends, empty ones left out. wanted (name, pages array<int>): only these, in that order; pages that don't exist are skipped, a null array takes all."""
    if wanted is None:
        placed = pages.withColumn("at", F.col("page_no"))
    else:
        asked = wanted.select("name", F.posexplode_outer("pages").alias("k", "page_no"))
        all_of, some = asked.where("page_no is null").select("name"), asked.where("page_no is not null")
        placed = pages.join(all_of, "name", "left_semi").withColumn("at", F.col("page_no")).unionByName(pages.join(some, ["name", "page_no"]).withColumn("at", F.col("k")).drop("k"))
    rows = F.array_sort(F.collect_list(F.struct("at", "page_text")))
    return placed.where(F.length("page_text") > 0).groupBy("genre", "name").agg(F.array_join(F.transform(rows, lambda r: r["page_text"]), "\n").alias("text"))


def missing_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, page_no): pages that are asked for of a file that was read, and don't exist in it."""
    asked = wanted.select("name", F.explode("pages").alias("page_no")).join(pages.select("name").distinct(), "name", "left_semi")
    return asked.join(pages.select("name", "page_no"), ["name", "page_no"], "left_anti")


def with_config(files: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their config, files without any), matched by lower-case name. config: (book, pages, start_marker, end_marker, patterns)."""
    key = F.lower(F.col("name")) == F.lower(F.col("book"))
    return files.join(config, key), files.join(config, key, "left_anti")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """A record for each row."""
    df.write.mode(mode).json(path)


def write_texts(df: DataFrame, path: str, mode: str = "error") -> None:
    """Cleaned texts (name, text) as a table; a file for each name would not scale."""
    df.write.mode(mode).parquet(path)


def cached(df_or_none: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """The table at path; where it isn't complete yet, it is made and written first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df_or_none().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def todo(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose results are not committed yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")
