"""Incremental linkage, an addition of this library: new records against a standing entity table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.config import LinkageConfig
from quillon.operators.blocking import capped, top_forward, union_evidence


def link_batch(new_keys: DataFrame, entity_keys: DataFrame, cfg: LinkageConfig = LinkageConfig()) -> DataFrame:
    """Candidate pairs of one batch's record keys with the entities' keys; caps are the batch's."""
    rows = new_keys.unionByName(entity_keys.where("src = 1"))
    return top_forward(union_evidence(*capped(rows, cfg)), "pre", cfg.keep)


def link_stream(new_keys: DataFrame, entity_keys: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: LinkageConfig = LinkageConfig()) -> StreamingQuery:
    """Run ``link_batch`` on each micro-batch; the sink gets (pairs, batch id) and must be idempotent by id."""
    each = lambda df, i: sink(link_batch(df, entity_keys, cfg), i)
    return new_keys.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Token or event counts by window with a bound on lateness; works on streams and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, span), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
