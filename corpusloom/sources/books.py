"""Boilerplate patterns by kind, and an example configuration table. Patterns are applied with case ignored and ^, $ at lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "book string, pages array<int>, start_marker string, end_marker string, patterns array<string>"
PAGE_NUMBER = r"^\s*\d+\s*$"
ROMAN_NUMERAL = r"\b[IVXLC]+\b\.?"
HEADING = r"^\s*(?:chapter|part|page)\s+\S+\s*$"
URL = r"https?://\S+"
UPDATED = r"last updated[^\n]*"
SITE = r"\bwww\.[a-z0-9.-]+\b"
TITLE_LINE = r"^(?:[A-Z][a-z]+ ?){1,6}$"
NUMERAL_SECTION = r"^[IVXLC]+\.\s+[A-Z ]+$"
#: A part's heading with all that stands before the chapter's on the same line.
PART_TO_CHAPTER = r"\bpart\s+[IVXLC]+\b.*?(?=\bchapter\b)"
NUMBER_PART = r"\bpart\s+(?:one|two|three|four|five|six|seven|eight|nine|ten)\b"
NUMERAL_LINE = r"^\s*[IVXLC]+\.?\s*$"
#: A numeral's line and the heading in the line below it.
NUMERAL_HEADING = r"^\s*[IVXLC]+\s*\n[A-Z ]{2,50}(?=\n)"
DOMAIN = r"\b[a-z0-9-]+\.(?:com|org|net)\b"
PATTERNS = {"part_to_chapter": PART_TO_CHAPTER, "number_part": NUMBER_PART, "numeral_line": NUMERAL_LINE, "numeral_heading": NUMERAL_HEADING, "domain": DOMAIN, "page_number": PAGE_NUMBER, "roman_numeral": ROMAN_NUMERAL, "heading": HEADING, "url": URL, "updated": UPDATED, "site": SITE, "title_line": TITLE_LINE, "numeral_section": NUMERAL_SECTION}


def config(spark: SparkSession, books: list[tuple]) -> DataFrame:
    """books: (book, pages or None, start marker or None, end marker or None, names of PATTERNS or patterns)."""
    rows = [(b, pages, start, end, [PATTERNS.get(p, p) for p in patterns]) for b, pages, start, end, patterns in books]
    return spark.createDataFrame(rows, SCHEMA)
