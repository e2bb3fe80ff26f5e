"""Learned ranking of candidates and meta-blocking: cheap evidence first, string scores for what is left.

A ranker is anything with ``score(df, name)``: a fitted ``models.Learned``, or a
``Linear`` whose weights are given, which is a plain column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window as W, functions as F

from quillon.config import LinkageConfig
from quillon.functions import rules
from quillon.functions.fuzzy import scorer
from quillon.operators import blocking as B, features as X, models as M
from quillon.scratch import Scratch

KEYS = X.KEYS
EVIDENCE = [f"w_{k}" for k in rules.CAPS]
CHEAP = ["c_tset", "a_tset", "hmain_eq", "n_inter"]
#: What the ranker of block evidence reads, and the one that sees cheap similarities of its shortlist.
STAGE0 = ["pre", "nk", "n_union", "r_pre", "rk_pre", *EVIDENCE]
STAGE1 = [*STAGE0, "s0", *CHEAP]
#: What the meta-blocking ranker reads.
META = [*X.CONTEXT, *EVIDENCE, *[f"k_{k}" for k in rules.KIND_BITS if k != "em"], *CHEAP]


class Ranker(Protocol):
    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the column ``name``, larger for likelier pairs."""


@dataclass(frozen=True)
class Linear:
    """The logistic of a weighted sum of columns; a missing value counts as 0."""

    weights: dict[str, float]
    bias: float = 0.0

    def score(self, df: DataFrame, name: str) -> DataFrame:
        total = F.lit(float(self.bias))
        for column, weight in self.weights.items():
            total = total + float(weight) * F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        return df.withColumn(name, 1 / (1 + F.exp(-total)))


def cheap(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds two token-set ratios, whether the main numbers are equal, and how many numbers are shared; records have core, adf, hmain, nt."""
    sides = X.attach(pairs, records, ["core", "adf", "hmain", "nt"])
    tset, text = scorer("token_set_ratio"), lambda c: F.coalesce(c, F.lit(""))
    same = F.coalesce((F.col("hmain_1") == F.col("hmain_2")) & (F.col("hmain_1") != ""), F.lit(False))
    return sides.select(
        *[F.col(c) for c in pairs.columns], tset(text("core_1"), text("core_2")).cast("float").alias("c_tset"), tset(text("adf_1"), text("adf_2")).cast("float").alias("a_tset"),
        same.cast("tinyint").alias("hmain_eq"), F.coalesce(F.size(F.array_intersect("nt_1", "nt_2")), F.lit(0)).alias("n_inter"),
    )


def shortlist(pairs: DataFrame, records: DataFrame, keep: int, first: Ranker | None = None, second: Ranker | None = None) -> DataFrame:
    """Pairs with ``score``: the best ``keep`` of each entity and source by the first ranker, scored by the second.

    Without a first ranker the evidence ``pre`` ranks all pairs; without a second one
    the first one's score stands.  The shortlist is written, so string scores are
    computed for it alone.  Ties go to the smaller record.
    """
    rows = B.with_union_context(pairs)
    if first is None:
        return rows.withColumn("score", F.col("pre"))
    short = B.top_forward(first.score(rows, "s0"), "s0", keep)
    if second is None:
        return short.withColumn("score", F.col("s0"))
    short = Scratch(pairs.sparkSession, "shortlist").keep(short, "short")
    return second.score(cheap(short, records), "score")


def candidates(records: DataFrame, cfg: LinkageConfig = LinkageConfig(), first: Ranker | None = None, second: Ranker | None = None) -> DataFrame:
    """Keys, caps, shared evidence and the best of each entity (and record) by the rankers; by evidence without any."""
    pairs = B.union_evidence(*B.capped(B.keys(records, cfg, Scratch(records.sparkSession, "blocks")), cfg))
    ranked = shortlist(pairs, records, cfg.shortlist, first, second)
    kept = B.top_either(ranked, "score", cfg.keep, cfg.reverse)
    return kept.select(*pairs.columns)


def sampled(entity: str, share: float, seed: int = 2026):
    """Whether an entity is in the sample of such a share, by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed + 3), entity), F.lit(1_000_000)) < int(share * 1_000_000)


@dataclass
class Stages:
    """first, second: the two rankers; report: recall at ``keep`` of each score on the half that none was fitted on."""

    first: Ranker
    second: Ranker
    report: DataFrame


def train_stages(records: DataFrame, truth: DataFrame, cfg: LinkageConfig = LinkageConfig(), share: float = 1.0, kind: str = "logistic", **options) -> Stages:
    """Both rankers from the whole unions of a share of the entities, half of them to fit and half to measure."""
    scratch = Scratch(records.sparkSession, "stages")
    pairs = B.union_evidence(*B.capped(B.keys(records, cfg, scratch), cfg)).where(sampled("e", share, cfg.seed))
    rows = scratch.keep(M.label(B.with_union_context(pairs), truth), "union")
    half = M.fold_of(F.col("e"), 2, cfg.seed)
    first = M.Learned.fit(rows.where(half == 0), STAGE0, kind, **options)
    short = scratch.keep(cheap(B.top_forward(first.score(rows, "s0"), "s0", cfg.shortlist), records), "short")
    second = M.Learned.fit(short.where(half == 0), STAGE1, kind, **options)
    test, true = second.score(short.where(half == 1), "s1"), truth.where(half == 1).where(sampled("e", share, cfg.seed))
    found = recall_at(rows.where(half == 1), true, ["pre"], cfg.keep).unionByName(recall_at(test, true, ["s0", "s1"], cfg.keep))
    return Stages(first, second, found)


def recall_at(pairs: DataFrame, truth: DataFrame, scores: list[str], k: int) -> DataFrame:
    """``(score, k, pairs, found, recall)``: true pairs among each entity and source's best k by each score."""
    place = lambda s: F.row_number().over(W.partitionBy("e", "src").orderBy(F.desc(s), "r"))
    ranked = pairs.withColumns({f"__{s}": place(s) for s in scores})
    hits = ranked.agg(*[F.coalesce(F.sum((F.col(f"__{s}") <= k).cast("int") * F.col("y")), F.lit(0)).alias(s) for s in scores])
    rows = hits.select(F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("long").alias("found")) for s in scores])).alias("x")).select("x.*")
    total = truth.agg(F.count("*").alias("pairs"))  # one row
    return rows.join(F.broadcast(total)).select("score", F.lit(k).alias("k"), "pairs", "found", F.try_divide(F.col("found").cast("double"), F.col("pairs").cast("double")).alias("recall"))


def meta_rows(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with META; the context must already be there, over all candidates."""
    return cheap(pairs.join(X.kind_flags(pairs), KEYS), records)


def metablock(pairs: DataFrame, records: DataFrame, ranker: Ranker, tau: float = 0.01) -> DataFrame:
    """The candidates whose ranker score is ``tau`` or more, and the best of each entity, with their columns as they came and ``meta``."""
    scored = ranker.score(meta_rows(pairs, records), "meta").select(*pairs.columns, "meta")
    return M.prune(Scratch(pairs.sparkSession, "meta").keep(scored, "scored"), "meta", tau)


def train_meta(rows: DataFrame, share: float = 1.0, kind: str = "logistic", seed: int = 2026, **options) -> M.Learned:
    """The meta-blocking ranker from labelled ``meta_rows`` of a share of the entities."""
    return M.Learned.fit(rows.where(sampled("e", share, seed + 1)), META, kind, **options)


def address_state(records: DataFrame) -> DataFrame:
    """``(src, r, addr)``: whether a record's address is empty, has no number, or has one."""
    state = F.when((F.col("ad") == "") & (F.col("nums") == ""), "empty").when(F.col("nums") == "", "no number").otherwise("has number")
    return records.where("src > 1").select("src", F.col("id").alias("r"), state.alias("addr"))


def recall_report(pairs: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """``(country, part, pairs, found, recall, all_found)`` by source and by address state; truth has country."""
    with_state = truth.join(address_state(records), ["src", "r"], "left")
    by_source = B.recall(pairs, truth, ["country", "src"]).withColumn("part", F.concat(F.lit("source "), F.col("src").cast("string"))).drop("src")
    return by_source.unionByName(B.recall(pairs, with_state, ["country", "addr"]).withColumnRenamed("addr", "part"))

