"""Candidate pairs from shared keys.

Records carry ``id, src`` (1: entities, 2 and 3: records), ``country`` and the
normalized columns.  A key belongs to a country: pairs never cross one.  A block
larger than its kind's cap is skipped on that side before the join, which also
bounds the join's fan-out; nothing is truncated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.config import LinkageConfig
from quillon.functions import rules
from quillon.operators.tokens import document_frequency, rarest, tokens
from quillon.scratch import Scratch

KEY = ["id", "src", "country"]


def blocking_tokens(records: DataFrame) -> DataFrame:
    """Adds the token arrays that keys are made of: name tokens and address words of two or more letters, and numbers."""
    return (
        records.withColumn("nt", tokens(F.col("core"), 2))
        .withColumn("at", tokens(F.col("ad"), 2))
        .withColumn("numbers", F.slice(tokens(F.col("nums")), 1, 3))
    )


def name_ranks(records: DataFrame, k: int = 3) -> DataFrame:
    """The k rarest name tokens of each record by frequency in its country; tokens seen once are left out."""
    return rarest(records, ["id", "src"], "nt", document_frequency(records, "nt", ["country"]), k, ["country"], min_df=2)


def word_ranks(records: DataFrame, k: int = 4) -> DataFrame:
    """The k rarest address words, without generic ones."""
    return rarest(records, ["id", "src"], "at", document_frequency(records, "at", ["country"]), k, ["country"], rules.ADDR_GENERIC, 2)


def _kind(rows: DataFrame, kind: str, key: Column) -> DataFrame:
    return rows.select(*KEY, F.lit(kind).alias("kind"), key.alias("key"))


def _pair(rows: DataFrame, kind: str) -> DataFrame:
    both = rows.where("place <= 2").groupBy(*KEY).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return _kind(both.where(F.size("ts") == 2), kind, F.array_join("ts", "|"))


def pair_keys(names: DataFrame) -> DataFrame:
    """np: the two rarest name tokens together."""
    return _pair(names, "np")


def single_keys(names: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """nt: each of the two rarest name tokens that few records have."""
    return _kind(names.where((F.col("place") <= 2) & (F.col("df") <= cfg.cap("nt"))), "nt", F.col("t"))


def compact_keys(records: DataFrame) -> DataFrame:
    """cc: the name without blanks, from six letters on."""
    return _kind(records.where(F.char_length("cc") >= 6), "cc", F.col("cc"))


def address_keys(words: DataFrame) -> DataFrame:
    """ap: the two rarest address words together."""
    return _pair(words, "ap")


def number_word_keys(records: DataFrame, words: DataFrame) -> DataFrame:
    """nw: each of the first three numbers with each of the four rarest address words."""
    numbers = records.select(*KEY, F.explode("numbers").alias("n"))
    return _kind(numbers.join(words, KEY), "nw", F.concat_ws("|", "n", "t"))


def number_name_keys(records: DataFrame, names: DataFrame) -> DataFrame:
    """nn: each of the first three numbers with each of the two rarest name tokens."""
    numbers = records.select(*KEY, F.explode("numbers").alias("n"))
    return _kind(numbers.join(names.where("place <= 2"), KEY), "nn", F.concat_ws("|", "n", "t"))


def house_keys(records: DataFrame, words: DataFrame) -> DataFrame:
    """hw: a house number of several groups with each of the four rarest address words."""
    return _kind(records.where(F.col("hn").contains("-")).select(*KEY, "hn").join(words, KEY), "hw", F.concat_ws("|", "hn", "t"))


def rare_keys(records: DataFrame, names: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """nr: each of the three rarest name tokens; of records only where they have no number."""
    usable = records.where((F.col("src") == 1) | (F.coalesce(F.col("nums"), F.lit("")) == "")).select(*KEY)
    return _kind(names.where(F.col("df") <= cfg.cap("nr")).join(usable, KEY), "nr", F.col("t"))


def compact_address_keys(records: DataFrame, words: DataFrame) -> DataFrame:
    """ca: the name without blanks, from four letters on, with each of the two rarest address words."""
    return _kind(records.where(F.char_length("cc") >= 4).select(*KEY, "cc").join(words.where("place <= 2"), KEY), "ca", F.concat_ws("|", "cc", "t"))


def keys(records: DataFrame, cfg: LinkageConfig = LinkageConfig(), scratch: Scratch | None = None) -> DataFrame:
    """``(id, src, country, kind, key)``: the distinct keys of all kinds.

    With ``scratch`` the token ranks and the keys, which several later steps read,
    are computed once and written.
    """
    keep = scratch.keep if scratch else lambda df, name: df
    rows = keep(blocking_tokens(records).select(*KEY, "nums", "hn", "cc", "nt", "at", "numbers"), "tokens")
    names, words = keep(name_ranks(rows), "names"), keep(word_ranks(rows), "words")
    parts = [number_word_keys(rows, words), pair_keys(names), single_keys(names, cfg), compact_keys(rows), address_keys(words)]
    parts += [number_name_keys(rows, names), house_keys(rows, words), rare_keys(rows, names, cfg)]
    if cfg.with_ca:
        parts.append(compact_address_keys(rows, words))
    return keep(reduce(DataFrame.unionByName, parts).distinct(), "keys")


def cap(kind: Column, cfg: LinkageConfig) -> Column:
    return reduce(lambda e, k: e.when(kind == k, cfg.cap(k)), rules.CAPS, F.when(F.lit(False), 0)).otherwise(0)


def block_sizes(key_rows: DataFrame) -> DataFrame:
    """``(src, country, kind, key, n)``."""
    return key_rows.groupBy("src", "country", "kind", "key").agg(F.count("*").alias("n"))


def capped(key_rows: DataFrame, cfg: LinkageConfig = LinkageConfig()) -> tuple[DataFrame, DataFrame]:
    """Entity keys and record keys whose blocks are within their caps; record keys carry the block's size ``n``."""
    within = block_sizes(key_rows)
    entity = within.where((F.col("src") == 1) & (F.col("n") <= int(cfg.entity_cap * cfg.cap_factor))).select("country", "kind", "key")
    record = within.where((F.col("src") > 1) & (F.col("n") <= cap(F.col("kind"), cfg)))
    left = key_rows.where("src = 1").join(entity, ["country", "kind", "key"], "left_semi").select(F.col("id").alias("e"), "country", "kind", "key")
    right = key_rows.where("src > 1").join(record, ["src", "country", "kind", "key"]).select("src", F.col("id").alias("r"), "country", "kind", "key", "n")
    return left, right


def union_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row a pair ``(e, src, r)``: ``pre`` sums 1 / log2(1 + block size) over shared keys, ``nk`` counts
    them, ``kinds`` has their bits, and ``w_<kind>`` the sum of each kind."""
    weight = 1 / F.log2(1 + F.col("n"))
    bit = reduce(lambda e, k: e.when(F.col("kind") == k, rules.KIND_BITS[k]), rules.CAPS, F.when(F.lit(False), 0)).otherwise(0)
    shared = left.join(right, ["country", "kind", "key"]).withColumn("w", weight)
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0)).alias(f"w_{k}") for k in rules.CAPS]
    return shared.groupBy("country", "e", "src", "r").agg(F.sum("w").alias("pre"), F.count("*").cast("int").alias("nk"), F.bit_or(bit).cast("int").alias("kinds"), *by_kind)


def with_union_context(pairs: DataFrame) -> DataFrame:
    """Adds n_union (pairs of the entity), r_pre (share of its best) and rk_pre (place)."""
    whole = W.partitionBy("e", "src")
    return pairs.withColumns({
        "n_union": F.count("*").over(whole), "r_pre": F.col("pre") / F.max("pre").over(whole),
        "rk_pre": F.row_number().over(whole.orderBy(F.desc("pre"), "r")),
    })


def top_forward(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best records of each entity and source, ties by record id."""
    place = F.row_number().over(W.partitionBy("e", "src").orderBy(F.desc(score), "r"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def top_reverse(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best entities of each record, ties by entity id."""
    place = F.row_number().over(W.partitionBy("src", "r").orderBy(F.desc(score), "e"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def top_either(pairs: DataFrame, score: str, forward: int, reverse: int) -> DataFrame:
    """Pairs among the best of their entity or of their record.

    Both places are taken of the same rows: a union of two filters computes the pairs twice, and sums of
    doubles that come out in another order make one pair two rows, or two ties another choice.
    """
    if not reverse:
        return top_forward(pairs, score, forward)
    ahead = F.row_number().over(W.partitionBy("e", "src").orderBy(F.desc(score), "r"))
    back = F.row_number().over(W.partitionBy("src", "r").orderBy(F.desc(score), "e"))
    both = pairs.withColumn("ahead", ahead).withColumn("back", back)
    return both.where((F.col("ahead") <= forward) | (F.col("back") <= reverse)).drop("ahead", "back")


def candidates(records: DataFrame, cfg: LinkageConfig = LinkageConfig()) -> DataFrame:
    """Keys, caps, shared evidence and the best of each entity (and record)."""
    pairs = union_evidence(*capped(keys(records, cfg, Scratch(records.sparkSession, "blocks")), cfg))
    return top_either(pairs, "pre", cfg.keep, cfg.reverse)


def merge_candidates(keyed: DataFrame, other: DataFrame, kind: str = "em") -> DataFrame:
    """Full union of key pairs with pairs of another origin, which have its bit and no key evidence."""
    extra = other.select("country", "e", "src", "r", F.lit(1).alias("__other"))
    both = keyed.join(extra, ["country", "e", "src", "r"], "full")
    bits = F.coalesce("kinds", F.lit(0)).bitwiseOR(F.when(F.col("__other") == 1, rules.KIND_BITS[kind]).otherwise(0))
    return both.withColumns({"pre": F.coalesce("pre", F.lit(0.0)), "nk": F.coalesce("nk", F.lit(0)), "kinds": bits}).drop("__other")


def recall(pairs: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Share of true pairs ``(e, src, r, by..)`` that are candidates, by strata, and entities with all found."""
    hit = truth.join(pairs.select("e", "src", "r", F.lit(1).alias("hit")), ["e", "src", "r"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    each = hit.groupBy(*by, "e").agg(F.count("*").alias("n"), F.sum("hit").alias("found"))
    return each.groupBy(*by).agg(
        F.sum("n").alias("pairs"), F.sum("found").alias("found"), (F.sum("found") / F.sum("n")).alias("recall"),
        F.avg((F.col("found") == F.col("n")).cast("double")).alias("all_found"),
    )


def missed(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that no key proposed."""
    return truth.join(pairs, ["e", "src", "r"], "left_anti")
