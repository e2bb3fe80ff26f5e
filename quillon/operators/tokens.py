"""Token lists, document frequencies, rarest tokens and inverse frequencies.

The scope of a frequency is always named by the caller: per country or whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct blank-separated tokens of at least ``least`` characters, in order of first place."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: F.length(t) >= least))


def document_frequency(df: DataFrame, token_array: str, scope: list[str] = ()) -> DataFrame:
    """``(scope.., t, df)``: rows that hold each token; arrays must be distinct."""
    return df.select(*scope, F.explode(token_array).alias("t")).groupBy(*scope, "t").agg(F.count("*").alias("df"))


def rarest(df: DataFrame, key: list[str], token_array: str, frequency: DataFrame, k: int, scope: list[str] = (), exclude: tuple[str, ...] = (), min_df: int = 1) -> DataFrame:
    """The k rarest tokens of each row, by (df, token): ``(key.., scope.., t, df, place)``."""
    rows = df.select(*key, *scope, F.explode(token_array).alias("t"))
    if exclude:
        rows = rows.where(~F.col("t").isin(*exclude))
    known = rows.join(frequency.where(F.col("df") >= min_df), [*scope, "t"])
    order = W.partitionBy(*key).orderBy("df", "t")
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*key, *scope, "t", "df", "place")


def with_rarest(df: DataFrame, key: list[str], token_array: str, frequency: DataFrame, name: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rarest token and its frequency (null and 0 without one); the frequency is over the whole split."""
    best = rarest(df, key, token_array, frequency, 1, exclude=exclude).select(*key, F.col("t").alias(name), F.col("df").alias(f"{name}_df"))
    return df.join(best, key, "left").withColumn(f"{name}_df", F.coalesce(f"{name}_df", F.lit(0)))


def idf(df: DataFrame, token_array: str, scope: list[str]) -> DataFrame:
    """``(scope.., t, idf)`` with ``ln(rows / df)``; rows without tokens count."""
    n = df.groupBy(*scope).agg(F.count("*").alias("n"))
    return document_frequency(df, token_array, scope).join(n, scope).select(*scope, "t", F.log(F.col("n") / F.col("df")).alias("idf"))
