"""Choosing a scorer of text pairs by its rank AUC on labelled pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillon.functions.fuzzy import scorer
from quillon.operators.evaluate import auc


def pilot(pairs: DataFrame, scorers: dict[str, str | Callable[[str, str], float]], left: str = "t1", right: str = "t2") -> DataFrame:
    """``(scorer, auc, rows)`` of every scorer on (y, left, right); scores are brought to 0 to 1 by their own range."""
    made = []
    for name, score in scorers.items():
        rows = pairs.select("y", scorer(score)(F.col(left), F.col(right)).alias("s"))
        span = rows.agg(F.min("s").alias("low"), F.max("s").alias("high"))  # one row
        scaled = rows.join(F.broadcast(span)).select("y", F.coalesce(F.try_divide(F.col("s") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("p"))
        made.append(auc(scaled).withColumn("scorer", F.lit(name)))
    return reduce(DataFrame.unionByName, made).select("scorer", "auc", "rows")


def best(report: DataFrame) -> str:
    """The scorer with the largest AUC; equal ones go to the smaller name."""
    return report.orderBy(F.desc_nulls_last("auc"), "scorer").first().scorer


def band_scores(exported: DataFrame, score: str | Callable[[str, str], float] = "ngram_cosine") -> DataFrame:
    """``(e, src, r, ce)`` of exported band pairs by a scorer of their texts."""
    return exported.select("e", "src", "r", scorer(score)(F.col("t1"), F.col("t2")).alias("ce"))
