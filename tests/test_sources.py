import pytest
from pyspark.sql import functions as F

from corpusloom.plans.runners import preprocess_pdfs
from corpusloom.sources import files
from corpusloom.sources.books import config
from corpusloom.streaming.incremental import process_new


def test_layout():
    at = files.Layout("/x/")
    assert at.raw() == "/x/raw_texts" and at.raw("novels") == "/x/raw_texts/novels"
    assert at.path("texts", "cleaned", "book", "b.txt") == "/x/texts/cleaned_texts/book/b.txt" and at.path("graphs", "network") == "/x/graphs/network_analysis"
    for layer, kind in (("texts", "network"), ("other", "cleaned"), ("embeddings", "")):
        with pytest.raises(ValueError):
            at.path(layer, kind)


def test_from_pdf_to_text(spark, tmp_path):
    for genre, name, pages in (("novels", "One", "front|BEGIN a\n 7 \nb END c|back"), ("novels", "Two", "x|y"), ("novellas", "Other", "z"), ("letters", "One", "no genre")):
        (tmp_path / genre).mkdir(exist_ok=True)
        (tmp_path / genre / f"{name}.pdf").write_bytes(pages.encode())
    books = config(spark, [("one", [2, 3, 9], "BEGIN", "END", ["page_number"]), ("TWO", None, None, None, [])])
    load = lambda: lambda b: b.decode().split("|")
    got = preprocess_pdfs(spark, str(tmp_path), books, load)
    assert {(r.genre, r.name, r.text) for r in got["texts"].collect()} == {("novels", "one", "BEGIN a b END"), ("novels", "two", "x y")}
    assert [tuple(r) for r in got["skipped"].collect()] == [("novellas", "other")] and [tuple(r) for r in got["missing_pages"].collect()] == [("one", 9)]
    again = preprocess_pdfs(spark, str(tmp_path), books, load, got["texts"])
    assert again["texts"].count() == 0 and again["skipped"].count() == 1


def test_no_pdf_library():
    try:
        files.pdf_reader()
    except RuntimeError as e:
        assert "pdfplumber" in str(e)


def test_texts_and_json(spark, tmp_path):
    d = tmp_path / "novels" / "book"
    d.mkdir(parents=True)
    (d / "one_cleaned.txt").write_text("a\nb", encoding="utf-8")
    (d / "skip.md").write_text("x")
    r = files.read_texts(spark, str(tmp_path)).collect()
    assert [(x.genre, x.book, x.name, x.text) for x in r] == [("novels", "book", "one", "a\nb")]
    files.write_json(spark.range(2), str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "id long").count() == 2


def test_pdf_pages(spark, tmp_path):
    for genre, name in (("novels", "A"), ("other", "B")):
        (tmp_path / genre).mkdir()
        (tmp_path / genre / f"{name}.pdf").write_bytes(b"p1|p2||p4")
    pages = files.read_pdf_pages(files.list_pdfs(spark, str(tmp_path)), lambda: lambda b: b.decode().split("|"))
    assert [r.text for r in files.pages_to_text(pages).collect()] == ["p1\np2\np4"]
    wanted = config(spark, [("a", [4, 9, 1], None, None, [])]).select(F.col("book").alias("name"), "pages")
    assert files.pages_to_text(pages, wanted).first().text == "p4\np1"
    found, missing = files.with_config(pages.select("name").distinct(), config(spark, [("zz", None, None, None, [])]))
    assert found.count() == 0 and missing.count() == 1


def test_cached_and_todo(spark, tmp_path):
    made = []
    for _ in range(2):
        df = files.cached(lambda: made.append(1) or spark.range(3), spark, str(tmp_path / "c"))
    assert df.count() == 3 and len(made) == 1
    assert files.todo(spark.range(5).toDF("doc_id"), spark.range(3).toDF("doc_id")).count() == 2


def test_stream(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    for k in range(2):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(src)
        process_new(spark, src, "id long", lambda d: d.withColumn("x", F.col("id") * 2), sink, cp).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(sink).collect()) == [0, 2]
