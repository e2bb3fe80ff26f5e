"""SQL access: every query as a temporary view, every string scorer as a function."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from quillon.functions.fuzzy import SCORERS, scorer
from quillon.plans import catalog


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None, prefix: str = "q_") -> list[str]:
    """Temporary views ``q_<name>`` of the named queries, or of all, over the tables of a folder.

    A view is a plan, not a table: it is computed when it is read, but for queries that write
    intermediate tables, which do so now.
    """
    made = []
    for name, query in catalog.queries().items():
        if names is None or name in names:
            query(spark, sf_dir).createOrReplaceTempView(f"{prefix}{name}")
            made.append(f"{prefix}{name}")
    return made


def register_functions(spark: SparkSession) -> list[str]:
    """The string scorers by their names, over two strings."""
    for name in SCORERS:
        spark.udf.register(name, scorer(name))
    return sorted(SCORERS)


