"""Calibration by stratum, rank AUC, clusters of entities and the paired cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.operators.graph import connected_components
from quillon.scratch import Scratch

GIANT = 0.05


def calibration(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, true rate, mean p, gap, Brier score, recall and misses at 0.5 of each stratum of ``(p, y)``."""
    p, y = F.col("p"), F.col("y").cast("double")
    low = (F.col("y") == 1) & (p < 0.5)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg(y).alias("true_rate"), F.avg(p).alias("mean_p"), F.avg(p - y).alias("gap"), F.avg((p - y) * (p - y)).alias("brier"),
        F.try_divide(F.sum(((F.col("y") == 1) & (p >= 0.5)).cast("double")), F.sum(y)).alias("recall05"), F.sum(low.cast("int")).alias("missed"),
    )
    total = F.sum("missed").over(W.partitionBy())
    return out.withColumn("share_missed", F.try_divide(F.col("missed").cast("double"), total.cast("double")))


def house_state(h1: Column, h2: Column, has1: Column, has2: Column) -> Column:
    return F.when((h1 == h2) & (h1 != ""), "same").when(has1 & has2, "differ").when(has1 | has2, "one missing").otherwise("both missing")


def ambiguity(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 5, "3-5").otherwise("6+")


def auc(rows: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Area under the ROC curve by average ranks, from counts of distinct scores; one class alone gives null.

    Ranks follow from running counts over score ranges, so no task needs all rows:
    the rows are first reduced to one a distinct score.
    """
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    cells = counts.withColumn("cell", F.floor(F.least(F.greatest(F.col("s").cast("double"), F.lit(0.0)), F.lit(1.0)) * 4096))
    per = cells.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("n").alias("cn"))  # 4097 cells at most
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("cell", F.coalesce(F.sum(F.col("cn") - F.col("cp")).over(before), F.lit(0)).alias("below"))
    inside = W.partitionBy("cell").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    lower = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(inside), F.lit(0))
    wins = cells.withColumn("lower", lower).join(per, "cell")
    win = F.col("pos") * (F.col("lower") + F.col("below") + (F.col("n") - F.col("pos")) / 2)
    totals = wins.agg(F.sum(win).alias("w"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return totals.select(F.try_divide(F.col("w"), (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"), F.col("n").alias("rows"))


def entity_clusters(pairs: DataFrame, fallback: DataFrame | None = None, giant: float = GIANT) -> tuple[DataFrame, str, float]:
    """``((e, cluster), kind, largest share)``: entities joined by shared records.

    If the largest cluster has more than ``giant`` of the entities, the groups of
    ``fallback (e, cluster)`` are taken instead.  Entity ids are kept apart from
    record ids by a sign, so ids must not be negative.
    """
    scratch = Scratch(pairs.sparkSession, "clusters")
    record = -(F.col("r") * 4 + F.col("src")) - 1
    edges = pairs.select(F.col("e").alias("a"), record.alias("b"))
    found = scratch.keep(connected_components(edges, scratch), "found")
    # a component is named by its least id, a record's; entities are named by their least entity
    mine = found.where("id >= 0").select(F.col("id").alias("e"), "component")
    named = mine.groupBy("component").agg(F.min("e").alias("cluster"), F.count("*").alias("n"))
    top = named.agg(F.max("n"), F.sum("n")).first()
    share = (top[0] or 0) / top[1] if top[1] else 0.0
    if share > giant and fallback is not None:
        return fallback, "groups", share
    return mine.join(named, "component").select("e", "cluster"), "components", share


def bootstrap(a: DataFrame, b: DataFrame, clusters: DataFrame, draws: int = 1000, seed: int = 2026, level: float = 0.95) -> DataFrame:
    """Paired difference of mean f (a less b) with a Poisson(1) cluster bootstrap: ``(delta, low, high, draws)``.

    a, b: ``(e, f)``; clusters: ``(e, cluster)``.  Clusters are dealt to ``draws``
    replicates by a hash each, and the replicates are summed before the shuffle.
    """
    both = a.select("e", F.col("f").alias("fa")).join(b.select("e", F.col("f").alias("fb")), "e").join(clusters, "e")
    per = both.groupBy("cluster").agg(F.sum(F.col("fa") - F.col("fb")).alias("s"), F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "cluster", "draw"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Poisson(1) by inversion; beyond 8 there is less than one part in a million
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(9):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u > s).cast("int") for s in steps[1:]), (u > steps[0]).cast("int"))
    rows = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    each = rows.groupBy("draw").agg((F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n")).cast("double"))).alias("d"))
    tail = (1 - level) / 2
    point = per.agg((F.sum("s") / F.sum("n")).alias("delta")).withColumn("one", F.lit(1))
    spread = each.agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"), F.count("*").alias("draws")).withColumn("one", F.lit(1))
    return point.join(F.broadcast(spread), "one").drop("one")  # one row


def weighted_mean(rows: DataFrame, weights: dict[str, float], by: str = "country", value: str = "f05") -> DataFrame:
    """Mean over the groups that have a weight, and the groups counted."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = rows.withColumn("w", F.try_element_at(w, F.col(by))).where("w is not null")
    return rows.agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value), F.count("*").alias("groups"))
