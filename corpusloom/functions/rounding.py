"""Decimal rounding as the exact binary value demands it: half to even, judged on the true value of the double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round_sql(x: str, places: int = 2) -> str:
    """SQL text, valid in Spark and in other engines with IEEE doubles, that rounds the double expression x to decimal places.

    x is split in two halves whose products with the scale are exact, so the distance from the tie has the right sign.
    """
    scale = f"{10**places}.0e0"
    high = f"(({x}) * 134217729.0e0 - (({x}) * 134217729.0e0 - ({x})))"
    n = f"cast(floor(({x}) * {scale}) as double)"
    rest = f"(({high} * {scale} - {n} - 0.5e0) + (({x}) - {high}) * {scale})"
    return f"((case when {rest} > 0 then {n} + 1 when {rest} < 0 then {n} when {n} - 2 * floor({n} / 2) = 0 then {n} else {n} + 1 end) / {scale})"


def exact_round(name: str, places: int = 2) -> Column:
    """The column of that name, a double, rounded."""
    return F.expr(exact_round_sql(f"`{name}`", places))
