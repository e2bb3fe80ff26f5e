"""From pair probabilities to lists: one owner a record, and the prefix with the best expected F0.5.

Pairs are ``(e, src, r, p)``.  All orders are full: p first, then ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def one_owner(pairs: DataFrame) -> DataFrame:
    """Each record stays with the entity that gives it the largest p, ties with the smallest entity."""
    place = F.row_number().over(W.partitionBy("src", "r").orderBy(F.desc("p"), "e"))
    return pairs.withColumn("place", place).where("place = 1").drop("place")


def prefixes(pairs: DataFrame) -> DataFrame:
    """Adds k, ctp (and cy where y is there): place, running sums of p and y; psum and pmax of the entity."""
    entity = W.partitionBy("e")
    order = entity.orderBy(F.desc("p"), "src", "r")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    p = F.col("p").cast("double")
    cols = {"k": F.row_number().over(order), "ctp": F.sum(p).over(run), "psum": F.sum(p).over(entity), "pmax": F.max(p).over(entity)}
    if "y" in pairs.columns:
        cols["cy"] = F.sum("y").over(run)
    return pairs.withColumns(cols)


def expected_f(ctp: Column, psum: Column, miss: Column, k: Column) -> Column:
    return 1.25 * ctp / (0.25 * (psum + miss) + k)


def with_thresholds(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds t_single, t_match, miss_mass of the pair's country, or of the row whose country is ``_default``."""
    names = ("t_single", "t_match", "miss_mass")
    own = thresholds.where("country <> '_default'").select("country", *names)
    other = F.broadcast(thresholds.where("country = '_default'").select(F.lit(1).alias("__one"), *[F.col(n).alias(f"d_{n}") for n in names]))  # one row
    joined = pairs.join(own, "country", "left").withColumn("__one", F.lit(1)).join(other, "__one", "left")
    return joined.withColumns({n: F.coalesce(n, f"d_{n}") for n in names}).drop("__one", *[f"d_{n}" for n in names])


def decode(pairs: DataFrame, t_single: float = 0.5, t_match: float = 0.3, miss_mass: float = 0.05, use_one_owner: bool = True, thresholds: DataFrame | None = None) -> DataFrame:
    """The pairs ``(e, src, r, p, k)`` of the chosen prefixes; an entity whose best p is below t_single has none."""
    owned = one_owner(pairs) if use_one_owner else pairs
    if thresholds is not None:
        owned = with_thresholds(owned, thresholds)
    else:
        owned = owned.withColumns({"t_single": F.lit(t_single), "t_match": F.lit(t_match), "miss_mass": F.lit(miss_mass)})
    # a window like those before it: one exchange by entity serves ranks, sums and the choice
    f = expected_f(F.col("ctp"), F.col("psum"), F.col("miss_mass"), F.col("k"))
    fit = (F.col("pmax") >= F.col("t_single")) & (F.col("p") >= F.col("t_match"))
    best = F.max_by("k", F.when(fit, F.struct(f, -F.col("k")))).over(W.partitionBy("e"))
    return prefixes(owned).withColumn("__k", best).where(F.col("k") <= F.col("__k")).select("e", "src", "r", "p", "k")


def f05(tp: Column, k: Column, n: Column) -> Column:
    """F0.5 of a list of k with tp true of n; without true ones an empty list scores 1."""
    return F.when(n == 0, (k == 0).cast("double")).when(k == 0, 0.0).otherwise(1.25 * tp / (0.25 * n + k))


def outcomes(decoded: DataFrame, labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """A row an entity of ``truth (e, n_true)``: n_ct true candidates, list length k, true ones tp, and f."""
    n_ct = labelled.groupBy("e").agg(F.sum("y").cast("double").alias("n_ct"))
    listed = decoded.join(labelled.select("e", "src", "r", "y"), ["e", "src", "r"], "left")
    listed = listed.groupBy("e").agg(F.count("*").cast("double").alias("k"), F.sum(F.coalesce("y", F.lit(0))).cast("double").alias("tp"))
    out = truth.select("e", F.col("n_true").cast("double").alias("n_true")).join(n_ct, "e", "left").join(listed, "e", "left").fillna(0.0)
    return out.withColumn("f", f05(F.col("tp"), F.col("k"), F.col("n_true")))


def decompose(out: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean F0.5 and the six parts of what it lacks, which sum to 1 - F0.5."""
    n, ct, k, tp, f = (F.col(c) for c in ("n_true", "n_ct", "k", "tp", "f"))
    part = (n > 0) & (k > 0)
    without_false = F.when(tp > 0, 1.25 * tp / (0.25 * n + tp)).otherwise(0.0)
    with_all = F.when(ct > 0, 1.25 * ct / (0.25 * n + ct)).otherwise(0.0)
    mean = lambda e: F.avg(e.cast("double"))
    only = lambda e: F.when(part, e).otherwise(0.0)
    return out.groupBy(*by).agg(
        mean(f).alias("f05"), mean((n == 0) & (k > 0)).alias("singleton_merged"), mean((n > 0) & (k == 0) & (ct > 0)).alias("emptied_findable"),
        mean((n > 0) & (k == 0) & (ct == 0)).alias("emptied_lost"), mean(only(without_false - f)).alias("false_pairs"),
        mean(only(with_all - without_false)).alias("missed_candidates"), mean(only(1.0 - with_all)).alias("lost_candidates"),
        F.count("*").alias("entities"), F.sum((n == 0).cast("int")).alias("singletons"), F.sum(k - tp).cast("long").alias("wrong_pairs"), F.sum(tp).cast("long").alias("correct_pairs"),
    )


GRID = {"t_single": (0.4, 0.5, 0.6), "t_match": (0.2, 0.3, 0.5), "miss_mass": (0.0, 0.05, 0.2)}


def threshold_grid(pairs: DataFrame, truth: DataFrame, grid: dict[str, tuple[float, ...]] = GRID, by: str | None = None, use_one_owner: bool = True) -> DataFrame:
    """Macro F0.5 of every grid point (t_match <= t_single) from one sort.

    Each point is one conditional aggregate of the entity's ranked pairs, so pairs
    are neither repeated nor shuffled again; the points become rows at the end.
    """
    points = [(a, b, c) for a in grid["t_single"] for b in grid["t_match"] for c in grid["miss_mass"] if b <= a]
    group = (by,) if by else ()
    ranked = prefixes(one_owner(pairs) if use_one_owner else pairs)
    score = {c: expected_f(F.col("ctp"), F.col("psum"), F.lit(c), F.col("k")) for c in grid["miss_mass"]}
    inside = lambda a, b: (F.col("pmax") >= a) & (F.col("p") >= b)
    best = [F.max_by(F.struct("k", "cy"), F.when(inside(a, b), F.struct(score[c], -F.col("k")))).alias(f"b{i}") for i, (a, b, c) in enumerate(points)]
    lists = truth.select("e", "n_true", *group).join(ranked.groupBy("e").agg(*best), "e", "left")
    n = F.col("n_true")
    sums = [F.sum(F.when(F.col(f"b{i}").isNull(), (n == 0).cast("double")).otherwise(f05(F.col(f"b{i}.cy"), F.col(f"b{i}.k"), n))).alias(f"s{i}") for i in range(len(points))]
    whole = lists.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.struct(*[F.lit(float(v)).alias(name) for name, v in zip(("t_single", "t_match", "miss_mass"), point)], (F.col(f"s{i}") / F.col("n")).alias("f05")) for i, point in enumerate(points)])
    return whole.select(*group, F.explode(rows).alias("g")).select(*group, "g.*")


def tune(grid: DataFrame, by: str) -> DataFrame:
    """The best grid point of each group, and a ``_default`` row with the largest of each threshold."""
    names = ("t_single", "t_match", "miss_mass")
    best = grid.groupBy(F.col(by).alias("country")).agg(F.max_by(F.struct(*names), F.struct("f05", *names)).alias("b")).select("country", "b.*")
    return best.unionByName(best.agg(F.lit("_default").alias("country"), *[F.max(n).alias(n) for n in names]))


def honest(pairs: DataFrame, truth: DataFrame, fold: Column, by: str, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """Macro F0.5 of each half by the thresholds tuned on the other, and both halves' mean by size: ``(by, fold, f05, entities)``.

    The owner step is over all pairs.  fold: 0 or 1 for an entity, as a column of ``e``.
    """
    owned, names = one_owner(pairs), ("t_single", "t_match", "miss_mass")
    halves = truth.withColumn("fold", fold)
    scores = [threshold_grid(owned, halves.where(F.col("fold") == f), grid, by, False).withColumn("fold", F.lit(f)) for f in (0, 1)]
    both = reduce(DataFrame.unionByName, scores)
    best = both.groupBy(by, "fold").agg(F.max_by(F.struct(*names), F.struct("f05", *names)).alias("b")).select(by, (1 - F.col("fold")).alias("fold"), "b.*")
    size = halves.groupBy(by, "fold").agg(F.count("*").alias("entities"))
    return both.join(best, [by, "fold", *names]).join(size, [by, "fold"]).select(by, "fold", "f05", "entities")


def ablate(pairs: DataFrame, labelled: DataFrame, truth: DataFrame, t_single: float = 0.5, t_match: float = 0.3, miss_mass: float = 0.05) -> DataFrame:
    """Decomposition of the decoder without each of its parts."""
    base = {"t_single": t_single, "t_match": t_match, "miss_mass": miss_mass}
    variants = {"full": {}, "no singleton gate": {"t_single": 0.0}, "no minimum p": {"t_match": 0.0}, "no missed-match prior": {"miss_mass": 0.0}, "no one-owner": {"use_one_owner": False}}
    made = [decompose(outcomes(decode(pairs, **(base | v)), labelled, truth)).withColumn("variant", F.lit(name)) for name, v in variants.items()]
    return reduce(DataFrame.unionByName, made)


def ceiling(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean F0.5 of a perfect scorer on the same candidates: ``(decoded, direct)``, equal up to rounding."""
    perfect = labelled.select("e", "src", "r", F.col("y").cast("double").alias("p"))
    out = outcomes(decode(perfect, 0.5, 0.5, 0.0), labelled, truth)
    direct = F.when(F.col("n_true") == 0, 1.0).when(F.col("n_ct") == 0, 0.0).otherwise(1.25 * F.col("n_ct") / (0.25 * F.col("n_true") + F.col("n_ct")))
    return out.agg(F.avg("f").alias("decoded"), F.avg(direct).alias("direct"))


def shift(p: Column, bias: float) -> Column:
    """p with its logit moved by ``bias``."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p.cast("double")))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + bias)))


def errors(decoded: DataFrame, labelled: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """False and missed pairs with a reason: singleton trap, wrong merge, blocking miss, model low."""
    key = ["e", "src", "r"]
    said, true = decoded.select(*key, F.lit(1).alias("listed")), truth_pairs.select(*key, F.lit(1).alias("linked"))
    owners = truth_pairs.select("e").distinct().withColumn("has", F.lit(1))
    seen = labelled.select(*key, F.lit(1).alias("seen"))
    odd = said.join(true, key, "full").where("listed is null or linked is null").join(owners, "e", "left").join(seen, key, "left")
    wrong = F.when(F.col("has").isNull(), "singleton trap").otherwise("wrong merge")
    lost = F.when(F.col("seen").isNull(), "blocking miss").otherwise("model low")
    return odd.select(*key, F.when(F.col("linked").isNull(), "FP").otherwise("FN").alias("error"), F.when(F.col("linked").isNull(), wrong).otherwise(lost).alias("reason"))
