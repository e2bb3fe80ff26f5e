"""The whole linkage run: raw sources to id lists.

Sources are tables (entity_id, business_name, business_address, country) by
number: 1 the entities, 2 and 3 the records.  Each stage that later ones read
more than once is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.config import LinkageConfig
from quillon.functions import normalize as N, rules
from quillon.operators import blocking as B, collective as C, decode as D, dictionary, features as X, models as M, ranking as R, tokens as T
from quillon.scratch import Scratch

KEYS = X.KEYS
SIDES = ["core", "cc", "nm", "legal", "script", "web", "ad", "adf", "nums", "hn", "hmain", "ct", "at", "nt", "rc", "rc_df", "ra", "ra_df", "wt", "wa"]
SETS = (
    "c_inter c_union c_only1 c_only2 a_inter a_union n_inter n_len1 n_len2 hmain_eq hn_eq h1_in_2 h2_in_1 hdiff legal_eq legal_e1 legal_e2 rc1_in_2 rc2_in_1 rc_df1 rc_df2 "
    "ra1_in_2 ra2_in_1 ra_df1 ra_df2 cc_in script_1 script_2 web_2 addr_empty2 len_c1 len_c2 c_jac a_jac n_jac"
).split()
IDF = [f"idf_{x}_{y}" for x in ("name", "addr") for y in ("jac", "cov1", "cov2")] + ["idf_name_miss"]
#: What the first scorer reads; the country is not among it.
FIRST = [*X.CONTEXT, *SETS, *X.FUZZY, "r_c_tset", "r_a_tset", "r_hn_eq", "has_ref", *[f"w_{k}" for k in rules.CAPS], *[f"k_{k}" for k in rules.KIND_BITS], *IDF]
#: What the second one reads: the stacker's columns, its p the first score.
SECOND = C.STACK


def normalized(sources: dict[int, DataFrame], words: Column | None = None, segments: Column | None = None) -> DataFrame:
    """One table of all sources' records in normal form: (id, src, country, raw columns, normal columns)."""
    rows = [df.select(F.col("entity_id").alias("id"), F.lit(k).alias("src"), "business_name", "business_address", "country") for k, df in sorted(sources.items())]
    named = N.with_name(reduce(DataFrame.unionByName, rows), "business_name", words)
    return N.with_address(named, "business_address", segments, words)


def is_latin(token: Column) -> Column:
    return ~token.rlike(r"[^\x00-\u024F]")


def build(sources: dict[int, DataFrame], known: dict[int, DataFrame], truth: DataFrame, folder: str) -> DataFrame:
    """Dictionaries mined from known sources' true pairs, then all ``sources`` in normal form, written to ``folder`` once.

    sources, known: raw tables (entity_id, business_name, business_address, country) by
    number; truth: (e, src, r) of the known ones.  Words are mined where a record's
    name is not in Latin letters and has as many words as its entity's, address segments (between
    commas) likewise.  A complete table in ``folder`` is read and not made again.
    """
    from quillon.sources.files import cached

    spark = truth.sparkSession
    raw = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("src"), "entity_id", "business_name", "business_address") for k, df in sorted(known.items())])
    one = raw.where("src = 1").select(F.col("entity_id").alias("e"), F.col("business_name").alias("n1"), F.col("business_address").alias("a1"))
    two = raw.where("src > 1").select("src", F.col("entity_id").alias("r"), F.col("business_name").alias("n2"), F.col("business_address").alias("a2"))
    pairs = truth.select("e", "src", "r").join(one, "e").join(two, ["src", "r"])
    words = lambda c: F.filter(F.split(F.lower(c), r"[\s,.]+"), lambda x: x != "")
    parts = lambda c: F.filter(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x)), lambda x: x != "")

    def make() -> DataFrame:
        mined = dictionary.mine_tokens(pairs, words("n2"), words("n1"), only=~is_latin(F.col("token")))
        segments = dictionary.mine_segments(pairs, F.filter(parts("a2"), lambda x: ~is_latin(x)), parts("a1"))
        return normalized(sources, dictionary.as_map(mined), dictionary.as_map(segments))

    return cached(spark, f"{folder}/normalized", make)


def enriched(records: DataFrame) -> DataFrame:
    """Adds token sets, the rarest tokens (frequencies over the whole split) and idf maps (by country)."""
    rows = records.withColumns({"ct": T.tokens(F.col("core")), "at": T.tokens(F.col("ad")), "nt": T.tokens(F.col("nums"))})
    rows = T.with_rarest(rows, ["id", "src"], "ct", T.document_frequency(rows, "ct"), "rc")
    rows = T.with_rarest(rows, ["id", "src"], "at", T.document_frequency(rows, "at"), "ra", rules.ADDR_GENERIC)
    for array, name in (("ct", "wt"), ("at", "wa")):
        rows = X.idf_lookup(rows, ["id", "src"], array, ["country"], T.idf(rows, array, ["country"]), name)
    return rows


def pair_features(pairs: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """FIRST for every candidate; they have their context already, which is over all candidates, before any pruning."""
    rows = pairs
    sides = scratch.keep(X.attach(rows.select(*KEYS), records, SIDES), "sides")
    groups = [X.set_features(sides), X.fuzzy_features(sides), X.kind_flags(rows), X.reference_features(rows, records), X.idf_features(sides, "wt", "idf_name", miss=True), X.idf_features(sides, "wa", "idf_addr")]
    return reduce(lambda a, b: a.join(b, KEYS), groups, rows)


@dataclass
class Linked:
    """decoded: chosen pairs with their place k; scored: all kept pairs with y and p; losses: one row; thresholds: by country."""

    decoded: DataFrame
    scored: DataFrame
    losses: DataFrame
    thresholds: DataFrame


@dataclass
class Matcher:
    """What a run learned: rankers of candidates, the pruning ranker, the fold models of both matchers, the second round's if it was adopted, and thresholds by country."""

    first: R.Ranker | None
    second: R.Ranker | None
    meta: R.Ranker | None
    matchers: list[M.Learned]
    stackers: list[M.Learned]
    again: list[M.Learned]
    thresholds: DataFrame

    _ONE = ("first", "second", "meta")
    _MANY = ("matchers", "stackers", "again")

    def save(self, path: str) -> None:
        from quillon.sources.files import write_json

        held = {n: getattr(self, n) for n in self._ONE}
        write_json(self.thresholds.sparkSession, {n: held[n] is not None for n in self._ONE} | {n: len(getattr(self, n)) for n in self._MANY}, f"{path}/parts")
        for name, model in held.items():
            if model is not None:
                model.save(f"{path}/{name}")
        for name in self._MANY:
            for i, model in enumerate(getattr(self, name)):
                model.save(f"{path}/{name}-{i}")
        self.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Matcher:
        from quillon.sources.files import read_json

        parts = read_json(spark, f"{path}/parts")
        one = [M.Learned.load(f"{path}/{n}") if parts[n] else None for n in Matcher._ONE]
        many = [[M.Learned.load(f"{path}/{n}-{i}") for i in range(parts[n])] for n in Matcher._MANY]
        return Matcher(*one, *many, spark.read.parquet(f"{path}/thresholds"))


def _stacked(pairs: DataFrame, rec: DataFrame, features: list[str], score) -> DataFrame:
    """Pairs re-scored from the views of their present p, which stays as p_r1."""
    rows = C.stack_features(pairs, rec).withColumn("p_r1", F.col("p"))
    keep = [*KEYS, *[c for c in ("y",) if c in pairs.columns], "p_first", *features]
    return score(rows.withColumn("p_first", F.col("p_first") if "p_first" in pairs.columns else F.col("p")).select(*dict.fromkeys(keep)))


def macro(scored: DataFrame, entities: DataFrame, thresholds: DataFrame) -> float:
    """Macro F0.5 of scored pairs decoded by thresholds."""
    chosen = D.decode(scored.join(entities.select("e", "country"), "e"), thresholds=thresholds)
    return D.outcomes(chosen, scored, entities).agg(F.avg("f")).first()[0] or 0.0


def fit(records: DataFrame, truth: DataFrame, cfg: LinkageConfig = LinkageConfig(), kind: str = "logistic", rank: bool = False, meta: bool = False, second_round: bool = False) -> tuple[Matcher, Linked]:
    """Out-of-fold linkage of normalized records with known truth ``(e, src, r)``, and what it learned.

    rank: candidates by learned rankers instead of their evidence; meta: pruning by a
    ranker of its own, before the dear features, instead of by the first matcher;
    second_round: re-score once more from the views of the stacked p, kept if its macro F0.5 is better with
    one of three moves of ``t_single``.
    """
    scratch = Scratch(records.sparkSession, "linkage")
    rec = scratch.keep(enriched(records), "records")
    n = truth.groupBy("e").agg(F.count("*").alias("n_true"))
    entities = scratch.keep(rec.where("src = 1").select(F.col("id").alias("e"), "country").join(n, "e", "left").fillna(0, ["n_true"]), "entities")
    stages = R.train_stages(rec, truth, cfg, kind=kind) if rank else None
    pairs = scratch.keep(X.context(R.candidates(rec, cfg, *((stages.first, stages.second) if stages else (None, None)))), "pairs")
    pruner = None
    if meta:
        pruner = R.train_meta(scratch.keep(M.label(R.meta_rows(pairs, rec), truth), "meta"), kind=kind, seed=cfg.seed)
        pairs = scratch.keep(R.metablock(pairs, rec, pruner, cfg.tau).drop("meta"), "pruned")
    rows = M.label(pair_features(pairs, rec, scratch), truth)
    first, matchers = M.fit_folds(rows.select(*KEYS, "y", *FIRST), FIRST, kind=kind)
    kept = scratch.keep(M.prune(first.select(*KEYS, "y", "p"), "p", cfg.tau), "kept")
    learned: dict[str, list[M.Learned]] = {}

    def by_folds(name: str, features: list[str]):
        def score(rows: DataFrame) -> DataFrame:
            scored, learned[name] = M.fit_folds(rows.withColumn("__p", F.col("p")), features, kind=kind, name="p_new")
            return scored.select(*KEYS, "y", "p_first", F.col("p_new").alias("p"))

        return score

    scored = scratch.keep(_stacked(kept, rec, SECOND, by_folds("stackers", SECOND)), "scored")
    thresholds = scratch.keep(D.tune(D.threshold_grid(scored, entities, by="country"), "country"), "thresholds")
    if second_round:
        again = scratch.keep(_stacked(scored, rec, [*SECOND, "p_r1"], by_folds("again", [*SECOND, "p_r1"])), "again")
        moved = [thresholds.withColumn("t_single", F.col("t_single") + d) for d in (-0.05, 0.0, 0.05)]
        values = [macro(again, entities, t) for t in moved]
        best = max(range(3), key=lambda i: (values[i], -abs(i - 1)))
        if values[best] > macro(scored, entities, thresholds):
            scored, thresholds = again, scratch.keep(moved[best], "thresholds-again")
        else:
            learned["again"] = []
    decoded = scratch.keep(D.decode(scored.join(entities.select("e", "country"), "e"), thresholds=thresholds), "decoded")
    scored = scored.select(*KEYS, "y", "p")
    matcher = Matcher(stages and stages.first, stages and stages.second, pruner, matchers, learned["stackers"], learned.get("again", []), thresholds)
    return matcher, Linked(decoded, scored, D.decompose(D.outcomes(decoded, scored, entities)), thresholds)


def run(records: DataFrame, truth: DataFrame, cfg: LinkageConfig = LinkageConfig(), kind: str = "logistic") -> Linked:
    """``fit`` in its plain form, without what it learned."""
    return fit(records, truth, cfg, kind)[1]


def score_split(matcher: Matcher, records: DataFrame, cfg: LinkageConfig = LinkageConfig()) -> tuple[DataFrame, DataFrame]:
    """``(scored, decoded)`` of normalized records without known truth, by a matcher learned on others.

    The context of a candidate is over all of them, so it comes before any pruning.  No
    fold model has seen these pairs: their score is the models' mean.  A country without thresholds takes the default ones.
    """
    scratch = Scratch(records.sparkSession, "split")
    rec = scratch.keep(enriched(records), "records")
    pairs = scratch.keep(X.context(R.candidates(rec, cfg, matcher.first, matcher.second)), "pairs")
    if matcher.meta is not None:
        pairs = scratch.keep(R.metablock(pairs, rec, matcher.meta, cfg.tau).drop("meta"), "pruned")
    first = M.mean_score(matcher.matchers, pair_features(pairs, rec, scratch).select(*KEYS, *FIRST))
    scored = scratch.keep(M.prune(first.select(*KEYS, "p"), "p", cfg.tau), "kept")
    for name, models in (("stacked", matcher.stackers), ("again", matcher.again)):
        if models:
            rescore = lambda rows, models=models: M.mean_score(models, rows, "p_new").select(*KEYS, "p_first", F.col("p_new").alias("p"))
            scored = scratch.keep(_stacked(scored, rec, list(models[0].features), rescore), name)
    countries = rec.where("src = 1").select(F.col("id").alias("e"), "country")
    decoded = scratch.keep(D.decode(scored.join(countries, "e"), thresholds=matcher.thresholds), "decoded")
    return scored.select(*KEYS, "p"), decoded


def chosen_thresholds(spark: SparkSession, folder: str, names: tuple[str, ...] = ("thresholds_final", "thresholds_oof", "thresholds")) -> DataFrame:
    """Thresholds of the most faithful tuning that a folder has: on pruned out-of-fold scores, on all of them, on a holdout."""
    from quillon.sources.files import exists, read_json, thresholds

    for name in names:
        if exists(spark, f"{folder}/{name}"):
            value = read_json(spark, f"{folder}/{name}")
            return thresholds(spark, {k: v for k, v in value.items() if not k.startswith("_") or k == "_default"})
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")
