"""Mixing sources to target weights, with DataFrame expressions only.

The mix takes an exact number of words from every source: some whole passes over
the source and a rest.  The rest is a quota that a splitting tree hands down: a
source's documents are hashed to 16**L leaves, and at each node the quota is
split over its 16 children by a multivariate hypergeometric draw, as if so many
words had been drawn from the node's words without replacement.  A leaf is a
source's part of an output shard.  In it the documents stand in a hashed
permutation and are taken in turn until the leaf's quota is full; the last one is
cut.  A shard has about ``leaf_rows`` documents of the largest source and fewer of
any other, whatever the sources' sizes, and is shuffled locally.  All draws are hashes of (seed, source, node), so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FAN = 16


@dataclass(frozen=True)
class MixConfig:
    """weights: of the sources by code point, null last, repeating; share: of all words that the mix has;
    limit: times of a source's words; leaf_rows: documents of a source in a leaf, about."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    limit: float = 2.0
    leaf_rows: int = 2048
    seed: int = 17


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """sizes: (src, none, source_size, docs), one row a source.  Adds ``target``: the shares by weight,
    stopped at ``limit`` times the size, with the excess reshared by weight until none is above.

    That fixed point is a water level: source i gets min(limit * size, level * weight),
    and the level follows from the sources in the order of limit * size / weight.
    """
    every = W.orderBy("none", "src")
    cycle = F.array(*[F.lit(float(w)) for w in cfg.weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(every) - 1, len(cfg.weights)) + 1))
    rows = rows.withColumn("cap", cfg.limit * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "none", "src")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = cfg.share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", left / weight).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(whole)
    target = F.least("cap", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return rows.withColumn("target", target).select("src", "none", "source_size", "docs", "target")


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


#: Logarithms of 0! to 9!; beyond, Stirling's series has all digits of a double.
_SMALL = [math.lgamma(i + 1) for i in range(10)]


def _log_factorials(a: Column, d: Column) -> Column:
    """log((a + d)!) - log(a!), without the loss of digits that the difference of two large logarithms has."""
    b = F.greatest(a + d, F.lit(0.0))
    small = F.array(*[F.lit(v) for v in _SMALL])
    stirling = lambda x: (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + rest(x)
    rest = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    one = lambda x: F.when(x < 10, F.element_at(small, F.least(x, F.lit(9.0)).cast("int") + 1)).otherwise(stirling(F.greatest(x, F.lit(10.0))))
    low, top = F.greatest(a, F.lit(10.0)), F.greatest(b, F.lit(10.0))
    wide = (low + 0.5) * F.log1p((top - low) / low) + (top - low) * (F.log(top) - 1) + rest(top) - rest(low)
    return F.when((a < 10) | (b < 10), one(b) - one(a)).otherwise(wide)


#: Tries of a draw; each succeeds with a chance of over one half.
TRIES = 128


def hypergeometric(population: Column, marked: Column, drawn: Column, *key: Column) -> Column:
    """How many of ``drawn`` words from ``population`` are among the ``marked``; the key's hashes are the draws.

    The exact law at any size, by the ratio of uniforms under Stadlober's hat (1990): a
    try takes the value below ``mean + 1/2 + width * (v - 1/2) / u`` and keeps it if ``u * u`` is at
    most its probability against the mode's.  After TRIES tries, a chance below
    2**-128, the mode is taken.
    """
    n, k, m = population.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, m * k / F.greatest(n, F.lit(1.0))).otherwise(0.0)
    variance = F.when(n > 1, mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - m) / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0)
    low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(m, k)
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
    width = 2 * math.sqrt(2 / math.e) * F.sqrt(F.greatest(variance, F.lit(0.0)) + 0.5) + (3 - 2 * math.sqrt(3 / math.e))

    def attempt(v: Column, i: Column) -> Column:
        u = _uniform(F.lit("u"), *key, i)
        place = F.floor(v["mean"] + 0.5 + v["width"] * (_uniform(F.lit("v"), *key, i) - 0.5) / u).cast("double")

        def verdict(t: Column) -> Column:
            d, x = t["place"] - v["mode"], v["mode"]
            less = _log_factorials(x, d) + _log_factorials(v["k"] - x, -d) + _log_factorials(v["m"] - x, -d) + _log_factorials(v["n"] - v["k"] - v["m"] + x, d)
            inside = (t["place"] >= v["low"]) & (t["place"] <= v["high"])
            return F.struct(F.when(inside, 2 * F.log(t["u"]) <= -less).otherwise(False).alias("done"), t["place"].alias("x"))

        return _let(F.struct(u.alias("u"), place.alias("place")), verdict)

    def draw(v: Column) -> Column:
        start = F.struct(F.lit(False).alias("done"), v["mode"].alias("x"))
        tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
        again = lambda a, i: F.when(a["done"], a).otherwise(attempt(v, i))
        return F.aggregate(tries, start, again, lambda a: F.when(a["done"], a["x"]).otherwise(v["mode"]).cast("long"))

    named = {"n": n, "k": k, "m": m, "mean": mean, "low": low, "high": high, "mode": mode, "width": width}
    return _let(F.struct(*[c.alias(name) for name, c in named.items()]), lambda v: F.when(v["low"] >= v["high"], v["low"].cast("long")).otherwise(draw(v)))


def split_quota(quota: Column, words: Column, *key: Column) -> Column:
    """The quota's split over children with ``words`` (array of FAN), by one draw a child from what is left."""
    start = F.struct(quota.alias("left"), F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"), F.array().cast("array<bigint>").alias("got"))

    def child(a: Column, w: Column) -> Column:
        draw = hypergeometric(a["pool"], w, a["left"], *key, F.size(a["got"]))
        return _let(draw, lambda x: F.struct((a["left"] - x).alias("left"), (a["pool"] - w).alias("pool"), F.concat(a["got"], F.array(x)).alias("got")))

    return F.aggregate(words, start, child, lambda a: a["got"])


def plan(rows: DataFrame, sizes_from: DataFrame, cfg: MixConfig) -> DataFrame:
    """rows: (doc_id, mark, src, none, size, ...), sizes_from: the same rows without other columns; mark is a hash of the text.

    Adds source_size, target, ``passes`` (whole passes over the source), ``part``
    (words taken beyond them, from the text's start) and the output ``shard``.
    """
    key = ["src", "none"]
    sizes = sizes_from.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(sizes, cfg).withColumn("quota", F.round("target").cast("long"))
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("quota", F.col("quota") - F.col("passes") * F.col("source_size"))
    goal = Scratch(rows.sparkSession, "mix").keep(goal, "goal")
    most = goal.agg(F.max("docs")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(1, most / cfg.leaf_rows), FAN)))
    leaf = F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit("leaf"), "doc_id", "mark"), F.lit(FAN**levels))
    words = sizes_from.where("size > 0").groupBy(*key, leaf.alias("leaf")).agg(F.sum("size").alias("words"))
    nodes = goal.select(*key, F.lit(0).cast("long").alias("node"), "quota")
    for level in range(1, levels + 1):
        below = FAN ** (levels - level)
        child = F.pmod(F.floor(F.col("leaf") / below), F.lit(FAN))
        by_child = F.array(*[F.coalesce(F.sum(F.when(child == c, F.col("words"))), F.lit(0)).cast("long") for c in range(FAN)])
        under = words.groupBy(*key, F.floor(F.col("leaf") / (below * FAN)).alias("node")).agg(by_child.alias("words"))
        got = split_quota(F.col("quota"), F.col("words"), F.lit(cfg.seed), F.lit(level), F.col("src"), F.col("none"), F.col("node"))
        split = nodes.join(under, [*key, "node"]).select(*key, "node", F.posexplode(got).alias("child", "quota"))
        nodes = split.select(*key, (F.col("node") * FAN + F.col("child")).alias("node"), "quota")
    # A leaf of every source goes to one output shard.  Its quota travels to its documents as a row of its own,
    # so one exchange by shard serves both, and each shard has its part of every source, hot ones included.
    carried = ["source_size", "target", "passes", "quota"]
    extra = [c for c in rows.columns if c not in ("doc_id", "mark", "src", "none", "size")]
    absent = lambda names, schema: [F.lit(None).cast(schema[c].dataType).alias(c) for c in names]
    quotas = goal.select(*key, "source_size", "target", "passes").join(nodes.withColumnRenamed("node", "shard"), key)
    heads = quotas.select(*key, "shard", *carried, F.lit(0).alias("role"), F.lit(0).cast("long").alias("size"), *absent(["doc_id", "mark", *extra], rows.schema))
    full = rows.where("size > 0").select(*key, leaf.alias("shard"), *absent(carried, heads.schema), F.lit(1).alias("role"), "size", "doc_id", "mark", *extra)
    turn = W.partitionBy(*key, "shard").orderBy("role", F.xxhash64(F.lit(cfg.seed), F.lit("turn"), "doc_id", "mark"), "doc_id", "mark").rowsBetween(W.unboundedPreceding, -1)
    both = heads.unionByName(full).repartition("shard").withColumns({c: F.first(c, ignorenulls=True).over(turn) for c in carried} | {"before": F.sum("size").over(turn)})
    part = F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("before"))).cast("long")
    some = both.where("role = 1").select("doc_id", "mark", *key, "size", *extra, "source_size", "target", "passes", part.alias("part"), "shard")
    # a text without words takes nothing, and its source may have no leaf at all
    none = rows.where("size = 0").join(goal.select(*key, "source_size", "target", "passes"), key).withColumns({"part": F.lit(0).cast("long"), "shard": leaf})
    return some.unionByName(none)


def _sized(df: DataFrame, doc_id: str, text: str, source: str, *extra: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.col(text).cast("string"))
    return df.select(F.col(doc_id).alias("doc_id"), mark.alias("mark"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.col(source).isNull().alias("none"), size.alias("size"), *extra)


def _draw(df: DataFrame, cfg: MixConfig, doc_id: str, text: str, source: str) -> DataFrame:
    """The columns of ``plan`` with the whole ``row``, its ``number``, and one row a copy with its ``cut`` text; a row that is not taken has a null copy."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    made = plan(_sized(df, doc_id, text, source, whole), Scratch(df.sparkSession, "mix").keep(_sized(df, doc_id, text, source), "sized"), cfg)
    copies = F.concat(F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    drawn = made.withColumn("number", F.monotonically_increasing_id()).select("*", F.posexplode_outer(copies).alias("copy", "words"))
    body = F.col(f"row.`{text}`")
    cut = F.when(F.col("words") >= F.col("size"), body).otherwise(F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " "))
    return drawn.withColumn("cut", F.when(F.col("copy").isNotNull(), cut))


def mix_report(df: DataFrame, cfg: MixConfig = MixConfig(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, shard)`` of every row: the words the mix takes, repeats
    counted in the texts that it draws, and the output shard that they go to.

    A text's size is its words; null texts and texts without words have 0 and give
    nothing.  A null source is a source of its own, the last.  Rows that repeat an
    id are separate documents; rows are dealt and ordered by hashes of id and text, so
    null and repeated ids are spread by their texts, and rows equal in both stand
    together, where it makes no difference which of them is cut.  No rows give no rows.
    """
    words = F.coalesce(F.sum(F.regexp_count("cut", F.lit(WORD))), F.lit(0)).cast("long")
    made = _draw(df, cfg, doc_id, text, source).groupBy("number", "doc_id", "size", "source_size", "target", "none", "src", "shard").agg(words.alias("taken"))
    return made.select("doc_id", "size", "source_size", "target", "taken", F.when(~F.col("none"), F.col("src")).alias("source"), "shard")


def mix(df: DataFrame, cfg: MixConfig = MixConfig(), doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``df``: each row as often as it is taken whole, and cut rows.

    A cut row's text is its first words joined by single spaces, and ``n_chars`` (if
    named and there) its length.  A text that is null or has no words is never taken; null and
    repeated ids, null sources and ties are as in ``mix_report``.  Rows come out by output shard, in a local shuffle:
    each shard is sorted by a hash of id and copy.
    """
    drawn = _draw(df, cfg, doc_id, text, source).where("copy is not null")
    out = drawn.sortWithinPartitions("shard", F.xxhash64(F.lit(cfg.seed), F.col(f"row.`{doc_id}`"), "copy"))
    column = lambda c: F.col("cut").alias(c) if c == text else F.char_length("cut").cast(df.schema[c].dataType).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c)
    return out.select(*[column(c) for c in df.columns])
