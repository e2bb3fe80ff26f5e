"""All registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import blocking, decode
from quillon.plans import blocking_queries, decode_queries, pair_queries, text_queries  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLES, QUERIES, Query, query


_SQL = f"""WITH {blocking_queries.RANKED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e, src ORDER BY pre DESC, r) AS z FROM ranked) WHERE z <= 15),
s AS (SELECT e, src, r, round(1 / (1 + exp(-(pre + 0.5 * nk - 3.0))), 9) AS p, 0 AS y FROM top), owned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, r ORDER BY p DESC, e) AS place FROM s) WHERE place = 1),
{decode_queries._ranked("owned", "places")}, {decode_queries._chosen(0.5, 0.3, 0.05, "places")} SELECT places.e, src, r, p, CAST(places.k AS INT) AS k FROM places JOIN ch ON ch.e = places.e WHERE places.k <= ch.k"""


@query(_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, capped blocks, evidence, the best of each entity, a squashed score, one owner and the best prefix, without a trained model."""
    pairs = blocking.top_forward(blocking_queries._rounded(spark, sf_dir), "pre", 15)
    p = 1 / (1 + F.exp(-(F.col("pre") + 0.5 * F.col("nk") - 3.0)))
    return decode.decode(pairs.select("e", "src", "r", F.round(p, 9).alias("p")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
