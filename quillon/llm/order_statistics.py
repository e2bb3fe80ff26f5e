"""The k-th largest value of a column by repeated exact counting, without sorting the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 512) -> float:
    """The largest v such that at least k rows have ``column >= v``; inf for k <= 0, -inf beyond the rows.

    Each round counts the rows of ``bins`` equal parts of the interval that holds
    the answer and goes on in one part, so the driver sees ``bins`` counts a
    round.  Nulls are not counted.
    """
    if k <= 0:
        return float("inf")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k > n:
        return float("-inf")
    above = 0  # rows beyond the interval [low, high]
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = rows.where(F.col("x").between(low, high))
        counts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for r in sorted(counts, key=lambda r: -r.part):
            if above + r.n >= k:
                low, high = r.a, r.b
                break
            above += r.n
    return low
