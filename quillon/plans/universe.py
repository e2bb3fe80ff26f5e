"""Linkage inputs made from the driver's tables.

Records: every document is a record of one of three sources (by id), its country
is the language, its name the words of the first line, its address the words of
all other lines, its numbers all digit runs.  Scored pairs: every order is an
entity, every part it has a record, with a made-up probability and truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.plans.registry import table

REC = r"""rec AS (SELECT doc_id AS id, CAST(doc_id % 3 + 1 AS INT) AS src, lang AS country, text,
  array_to_string(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+'), ' ') AS core,
  array_to_string(regexp_extract_all(lower(substr(text, length(split_part(text, chr(10), 1)) + 2)), '[a-z]+'), ' ') AS ad,
  array_to_string(regexp_extract_all(text, '[0-9]+'), ' ') AS nums, regexp_extract(text, '[0-9]+(?:-[0-9]+)+') AS hn FROM documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, src, country, text, core, ad, nums, hn, cc)."""
    first = F.substring_index("text", "\n", 1)
    words = lambda c, p: F.array_join(F.regexp_extract_all(c, F.lit(p), F.lit(0)), " ")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("lang").alias("country"), "text",
        words(F.lower(first), "[a-z]+").alias("core"), words(F.lower(F.substr("text", F.char_length(first) + 2)), "[a-z]+").alias("ad"),
        words(F.col("text"), "[0-9]+").alias("nums"), F.regexp_extract("text", "[0-9]+(?:-[0-9]+)+", 0).alias("hn"),
    )
    return rows.withColumn("cc", F.replace("core", F.lit(" "), F.lit("")))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with short names: the brand is the country, the type the address, the size the number."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("src"), F.col("p_brand").alias("country"), F.col("p_name").alias("text"),
                    F.lower("p_name").alias("core"), F.lower("p_type").alias("ad"), F.col("p_size").cast("string").alias("nums"), F.lit("").alias("hn"))
    return rows.withColumn("cc", F.replace("core", F.lit(" "), F.lit("")))


SCORED = """scored AS (SELECT l_orderkey AS e, CAST(2 + l_partkey % 2 AS INT) AS src, l_partkey AS r,
  round(max((l_linenumber * 7919 + l_suppkey * 104729 + l_partkey * 31 + l_orderkey * 17) % 1000) / 1000.0 * 0.6 + 0.35 * CAST((l_orderkey + l_partkey) % 3 = 0 AS INT), 6) AS p,
  CAST((l_orderkey + l_partkey) % 3 = 0 AS INT) AS y FROM lineitem GROUP BY l_orderkey, l_partkey),
truth AS (SELECT o_orderkey AS e, coalesce(sum(y), 0) + CAST(o_orderkey % 5 = 0 AS INT) AS n_true, any_value(o_orderpriority) AS country
  FROM orders LEFT JOIN scored ON e = o_orderkey GROUP BY o_orderkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(e, src, r, p, y)."""
    item = table(spark, sf_dir, "lineitem")
    y = ((F.col("e") + F.col("r")) % 3 == 0).cast("int")
    mixed = (F.col("l_linenumber") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_partkey") * 31 + F.col("l_orderkey") * 17) % 1000
    rows = item.groupBy(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("r")).agg(F.max(mixed).alias("m")).withColumn("y", y)
    return rows.select("e", (2 + F.col("r") % 2).cast("int").alias("src"), "r", F.round(F.col("m") / 1000.0 * 0.6 + 0.35 * F.col("y"), 6).alias("p"), "y")


def truth(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """(e, n_true, country) of every order: its true pairs, and one that no candidate is for each fifth."""
    n = pairs.groupBy("e").agg(F.sum("y").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("e"), F.col("o_orderpriority").alias("country"))
    return orders.join(n, "e", "left").select("e", (F.coalesce("n", F.lit(0)) + (F.col("e") % 5 == 0).cast("int")).alias("n_true"), "country")
