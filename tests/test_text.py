import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.rounding import exact_round
from corpusloom.functions.text import base_name, clean_text, midpoint, remove_boilerplate, remove_patterns
from corpusloom.operators.windows import chunks, sliding, tumbling
from corpusloom.sources.books import PATTERNS, config
from corpusloom.plans import runners
from corpusloom.plans.runners import preprocess


def test_exact_round(spark):
    xs = [0.125, 2.675, 1.005, -0.125, -2.675, 0.0, 1e-9, 0.375, 12345.675, *[k / 1000 for k in range(-2000, 2000, 5)], *[k / 8 for k in range(50)], *[1 / k for k in range(1, 60)]]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", exact_round("x").alias("a"), exact_round("x", 3).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(round(r.x, 2), round(r.x, 3)) for r in got]


def test_clean_text(spark):
    rows = ["  a \t b\n\nc  ", "", " x y\u0085", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(clean_text(F.col("t"))).collect()]
    assert got == ["a b c", "", "x y", None]


def test_markers(spark):
    cases = [("x START a START b END c END", "START a START b END"), ("END x START y", "START y"), ("no", "no"), ("STA\nRT x END", "STA RT x END")]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(remove_boilerplate(F.col("t"), [], F.lit("START"), F.lit("END"))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_patterns(spark):
    text = "Chapter 3\nI was ill in XIV. days\n 12 \nsee https://a.b/c now\nwww.site.org"
    got = spark.createDataFrame([(text,)], "t string").select(*[remove_patterns(F.col("t"), [PATTERNS[p]]).alias(p) for p in ("heading", "roman_numeral", "page_number", "url", "site")]).first()
    assert "Chapter" not in got["heading"] and " 12 " not in got["page_number"] and "https" not in got["url"] and "site.org" not in got["site"]
    assert "I was" not in got["roman_numeral"] and "XIV" not in got["roman_numeral"] and "days" in got["roman_numeral"] and " ill " not in got["roman_numeral"]


def test_patterns_of_books(spark):
    cases = {
        "part_to_chapter": ("PART II the sea CHAPTER 3 text", "CHAPTER 3 text"), "number_part": ("Part Two\nIt was", "It was"), "numeral_line": ("end.\n  XIV \nI. \nI was", "end. I was"),
        "numeral_heading": ("a\nIV\nNIGHT FALLS\nIt", "a It"), "domain": ("from some-books.com here", "from here"),
    }
    for name, (text, want) in cases.items():
        assert spark.range(1).select(remove_boilerplate(F.lit(text), [PATTERNS[name]])).first()[0] == want, name


def test_preprocess_by_config(spark):
    books = config(spark, [("one", None, "BEGIN", None, ["page_number"]), ("two", None, None, None, [])])
    texts = spark.createDataFrame([("One", "junk BEGIN a\n 7 \nb"), ("two", " x  y "), ("three", "z")], "name string, text string")
    assert {r.name: r.text for r in preprocess(texts, books).collect()} == {"One": "BEGIN a b", "two": "x y"}


def test_small_scalars(spark):
    row = spark.range(1).select(base_name(F.lit("/a/b/c_cleaned.txt")), midpoint(F.lit(3), F.lit(6))).first()
    assert tuple(row) == ("c", 4)


def windows_model(values, n):
    out = []
    for i in range(0, len(values), n):
        part = values[i : i + n]
        numbers = [v for v in part if v is not None]
        out.append((i // n, i, i + len(part) - 1, round(statistics.mean(numbers), 2) if part[0] is not None else None))
    return out


def test_tumbling(spark):
    for values in ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], [None, 2.0, 3.0, 1.0, None, 2.25], [0.125], [1.0, None, None]):
        df = spark.createDataFrame([(1, i, v, f"s{i}") for i, v in enumerate(values)], "doc_id long, sent_id int, v double, s string")
        got = tumbling(df, 3, [], firsts=["s"], nullable=["v"]).orderBy("window_id").collect()
        assert [(r.window_id, r.start_sentence, r.end_sentence, r.v) for r in got] == windows_model(values, 3)
        assert [r.s for r in got] == [f"s{i}" for i in range(0, len(values), 3)]


def test_sliding(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, 0, 1.0), (2, 1, 2.0)], "doc_id long, sent_id int, v double")
    got = sliding(df, 3, ["v"]).orderBy("start_sentence").collect()
    assert [(r.doc_id, r.start_sentence, r.end_sentence, r.v) for r in got] == [(1, 0, 2, 1.0), (1, 1, 3, 2.0)]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 30), st.integers(2, 8), st.integers(0, 1))
def test_chunks(spark, n, size, stride):
    df = spark.createDataFrame([(1, [f"w{k}" for k in range(n)])], "doc_id long, tokens array<string>")
    got = [(r.start_token, r.end_token, r.num_tokens, r.chunk) for r in chunks(df, size, stride).orderBy("chunk_id").collect()]
    words = [f"w{k}" for k in range(n)]
    assert got == [(i, min(i + size, n), len(words[i : i + size]), words[i : i + size]) for i in range(0, n, size - stride)]
    assert not math.isnan(len(got))


def test_preprocess_with_many_books(spark, monkeypatch):
    n = 100_010
    books = spark.range(n).selectExpr("concat('b', id) as book", "cast(null as string) as start_marker", "cast(null as string) as end_marker", "cast(null as array<string>) as patterns")
    texts = books.selectExpr("book as name", "'x' as text")
    assert preprocess(texts, books).count() == n
    monkeypatch.setattr(runners, "FEW_BOOKS", n)
    assert preprocess(texts, books).count() == n
