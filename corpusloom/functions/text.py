"""Column expressions on text: white space, markers, boilerplate, word filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python calls white space, for the JVM's regular expressions.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
ALPHA = r"^\p{L}+$"


def clean_text(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; case and punctuation stay."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def trim_to_start(text: Column, marker: Column) -> Column:
    """From the first occurrence of marker, which stays; unchanged without one."""
    at = F.position(marker, text)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def trim_to_end(text: Column, marker: Column) -> Column:
    """Up to the first occurrence of marker, which stays; unchanged without one."""
    at = F.position(marker, text)
    return F.when(at > 0, F.substr(text, F.lit(1), at + F.length(marker) - 1)).otherwise(text)


def remove_patterns(text: Column, patterns: list[str]) -> Column:
    """Each match of each pattern in turn becomes a space. Case is ignored, and ^ and $ stand at lines."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?imu){p}", " ")
    return text


def remove_boilerplate(text: Column, patterns: list[str], start: Column | None = None, end: Column | None = None) -> Column:
    """Trims to the markers (the end marker is looked for behind the start), takes the patterns out, and cleans white space."""
    if start is not None:
        text = F.when(start.isNotNull(), trim_to_start(text, start)).otherwise(text)
    if end is not None:
        text = F.when(end.isNotNull(), trim_to_end(text, end)).otherwise(text)
    return clean_text(remove_patterns(text, patterns))


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def is_alpha(word: Column) -> Column:
    return word.rlike(ALPHA)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; 0 where d is 0."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def base_name(path: Column) -> Column:
    """A file's name without folders, suffix and the mark of cleaned texts."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", ""), F.lit("_cleaned"), F.lit(""))


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. The optimizer would put an expression into the lambda that reads it, where it is computed for every element; it puts nothing into a generator."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select("*", "_once.*").drop("_once")


def min_max(x: Column, over) -> Column:
    """x scaled to 0..1 among its group; 0 where all are alike."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))
