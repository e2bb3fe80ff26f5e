"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex that has an edge: ``(id, component)``.

    Alternates the large-star and small-star contractions (Kiveris et al.,
    2014), each a grouped minimum and a join, until the edge set is a set of
    stars.  A vertex's neighbours are never gathered into a list, so a hub of
    any degree is safe: the minimum is combined before the shuffle, and the
    join with the hub's single minimum row can be split by the adaptive
    planner.  Every round is written to the shared folder and takes the place of the last.

    Nulls in either end drop the edge; self loops give a component of one;
    repeated edges count once; no edges give no rows.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = both.where("u = v").select(F.col("u").alias("id"))
    held = f"edges-{_tag()}"
    current = scratch.keep(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), held)
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        sym = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, held = held, f"edges-{_tag()}"
        current = scratch.keep(small, held)
        scratch.drop(last)
        summary = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (summary.n, summary.h):
            break
        state = (summary.n, summary.h)
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("id"), "component").distinct()
    lone = loops.distinct().join(stars.select("id").union(roots.select("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.union(roots).union(lone)


def _tag() -> str:
    import uuid

    return uuid.uuid4().hex[:12]
