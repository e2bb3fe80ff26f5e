"""Translation dictionaries mined from pairs of texts that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def mine_tokens(pairs: DataFrame, left: Column, right: Column, least: int = 2, share: float = 0.5, only: Column | None = None) -> DataFrame:
    """``(token, meaning, n, total)``: the right token most often at a left token's place in pairs of equal length.

    Kept from ``least`` occurrences and a share on; equal counts go to the smaller token.
    only: a condition on ``token`` (for instance its script).
    """
    rows = pairs.select(left.alias("l"), right.alias("r")).where((F.size("l") == F.size("r")) & (F.size("l") > 0))
    both = rows.select(F.explode(F.arrays_zip("l", "r")).alias("z")).select(F.col("z.l").alias("token"), F.lower("z.r").alias("meaning"))
    if only is not None:
        both = both.where(only)
    counts = both.groupBy("token", "meaning").agg(F.count("*").alias("n"))
    best = counts.groupBy("token").agg(F.sum("n").alias("total"), F.max(F.col("n")).alias("n"), F.min_by("meaning", F.struct(-F.col("n"), "meaning")).alias("meaning"))
    return best.where((F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("token", "meaning", "n", "total")


def mine_segments(pairs: DataFrame, left: Column, right: Column, least: int = 3) -> DataFrame:
    """``(segment, meaning, n, total)``: the right segment that most often stands in a pair with a left one."""
    rows = pairs.select(F.explode(left).alias("segment"), right.alias("r")).select("segment", F.explode("r").alias("meaning"))
    counts = rows.groupBy("segment", "meaning").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("n"), "meaning"))
    total = F.sum("n").over(W.partitionBy("segment"))
    return counts.withColumn("total", total).withColumn("place", place).where((F.col("place") == 1) & (F.col("total") >= least)).select("segment", "meaning", "n", "total")


def as_map(mined: DataFrame, most: int = 200_000) -> Column:
    """A mined dictionary as a literal map column; refuses one of more than ``most`` entries."""
    rows = mined.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries; join the dictionary instead")
    entries = [F.lit(x) for r in rows for x in (r[0], r[1])]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
