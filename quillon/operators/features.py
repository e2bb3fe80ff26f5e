"""Features of candidate pairs: ``pairs`` have (e, src, r), entity and record columns the suffixes _1 and _2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.functions import rules
from quillon.functions.fuzzy import scorer

KEYS = ["e", "src", "r"]
CONTEXT = ("pre", "nk", "rank1", "rank1s", "rel1", "rank2", "rel2", "n2")
FUZZY = {
    "c_ratio": ("core", "ratio"), "c_tset": ("core", "token_set_ratio"), "c_tsort": ("core", "token_sort_ratio"), "c_part": ("core", "partial_ratio"),
    "c_jw": ("core", "jaro_winkler"), "cc_ratio": ("cc", "ratio"), "n_tset": ("nm", "token_set_ratio"), "a_tset": ("adf", "token_set_ratio"),
    "a_ratio": ("adf", "ratio"), "w_tset": ("ad", "token_set_ratio"), "w_part": ("ad", "partial_ratio"),
}


def context(pairs: DataFrame) -> DataFrame:
    """Places and relative scores of a pair within its entity and its record, and the entity's best other record."""
    entity, own, record = W.partitionBy("e"), W.partitionBy("e", "src"), W.partitionBy("src", "r")
    best = F.desc("pre")
    out = pairs.withColumns({
        "rank1": F.row_number().over(entity.orderBy(best, "src", "r")), "rank1s": F.row_number().over(own.orderBy(best, "r")),
        "rel1": F.col("pre") / F.max("pre").over(entity), "rank2": F.row_number().over(record.orderBy(best, "e")),
        "rel2": F.col("pre") / F.max("pre").over(record), "n2": F.count("*").over(record),
    })
    at = lambda k: F.max(F.when(F.col("rank1") == k, F.struct("src", "r"))).over(entity)
    other = F.when(F.col("rank1") == 1, at(2)).otherwise(at(1))
    return out.withColumn("__o", other).withColumn("ref_src", F.col("__o.src")).withColumn("ref_r", F.col("__o.r")).drop("__o")


def attach(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with both sides' columns."""
    one = records.where("src = 1").select(F.col("id").alias("e"), *[F.col(c).alias(f"{c}_1") for c in columns])
    two = records.where("src > 1").select("src", F.col("id").alias("r"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(one, "e", "left").join(two, ["src", "r"], "left")


def _size(a: Column) -> Column:
    return F.size(a).cast("int")


def _holds(array: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(array, item), F.lit(False))


def set_features(p: DataFrame) -> DataFrame:
    """Counts, flags and Jaccard shares of name tokens (ct), address words (at) and numbers (nt); needs
    ct, at, nt, hmain, hn, legal, rc, rc_df, ra, ra_df, cc, script, web, ad, nums of both sides."""
    c = F.col
    both = lambda x: (F.array_intersect(f"{x}_1", f"{x}_2"), F.array_union(f"{x}_1", f"{x}_2"))
    (ci, cu), (ai, au), (ni, _) = both("ct"), both("at"), both("nt")
    h1, h2 = c("hmain_1"), c("hmain_2")
    cols = {
        "c_inter": _size(ci), "c_union": _size(cu), "c_only1": _size(F.array_except("ct_1", "ct_2")), "c_only2": _size(F.array_except("ct_2", "ct_1")),
        "a_inter": _size(ai), "a_union": _size(au), "n_inter": _size(ni), "n_len1": _size(c("nt_1")), "n_len2": _size(c("nt_2")),
        "hmain_eq": (h1 == h2) & (h1 != ""), "hn_eq": (c("hn_1") == c("hn_2")) & (c("hn_1") != ""),
        "h1_in_2": _holds(c("nt_2"), h1), "h2_in_1": _holds(c("nt_1"), h2),
        "hdiff": F.log1p(F.abs(h1.try_cast("double") - h2.try_cast("double"))),
        "legal_eq": c("legal_1") == c("legal_2"), "legal_e1": c("legal_1") == "", "legal_e2": c("legal_2") == "",
        "rc1_in_2": _holds(c("ct_2"), c("rc_1")), "rc2_in_1": _holds(c("ct_1"), c("rc_2")), "rc_df1": F.log1p("rc_df_1"), "rc_df2": F.log1p("rc_df_2"),
        "ra1_in_2": _holds(c("at_2"), c("ra_1")), "ra2_in_1": _holds(c("at_1"), c("ra_2")), "ra_df1": F.log1p("ra_df_1"), "ra_df2": F.log1p("ra_df_2"),
        "cc_in": F.contains(c("cc_2"), c("cc_1")) | F.contains(c("cc_1"), c("cc_2")),
        "script_1": c("script_1"), "script_2": c("script_2"), "web_2": c("web_2"), "addr_empty2": (c("ad_2") == "") & (c("nums_2") == ""),
        "len_c1": _size(c("ct_1")), "len_c2": _size(c("ct_2")),
    }
    flags = {"hmain_eq", "hn_eq", "h1_in_2", "h2_in_1", "legal_eq", "legal_e1", "legal_e2", "rc1_in_2", "rc2_in_1", "ra1_in_2", "ra2_in_1", "cc_in", "addr_empty2"}
    out = p.select(*KEYS, *[(v.cast("tinyint") if k in flags else v).alias(k) for k, v in cols.items()])
    over = lambda n, d: F.col(n) / F.greatest(d, F.lit(1))
    return out.withColumns({"c_jac": over("c_inter", F.col("c_union")), "a_jac": over("a_inter", F.col("a_union")), "n_jac": over("n_inter", F.col("n_len1") + F.col("n_len2") - F.col("n_inter"))})


def fuzzy_features(p: DataFrame) -> DataFrame:
    """The eleven string scores, each over distinct string pairs of a batch."""
    return p.select(*KEYS, *[scorer(s)(F.col(f"{x}_1"), F.col(f"{x}_2")).cast("float").alias(name) for name, (x, s) in FUZZY.items()])


def reference_features(p: DataFrame, records: DataFrame) -> DataFrame:
    """Likeness to the entity's best other record (from ``context``): r_c_tset, r_a_tset, r_hn_eq, has_ref."""
    txt = records.where("src > 1")
    own = txt.select("src", F.col("id").alias("r"), F.col("core").alias("c0"), F.col("adf").alias("a0"), F.col("hmain").alias("h0"))
    ref = txt.select(F.col("src").alias("ref_src"), F.col("id").alias("ref_r"), F.col("core").alias("c1"), F.col("adf").alias("a1"), F.col("hmain").alias("h1"))
    j = p.select(*KEYS, "ref_src", "ref_r").join(own, ["src", "r"], "left").join(ref, ["ref_src", "ref_r"], "left")
    tset = scorer("token_set_ratio")
    return j.select(
        *KEYS, tset(F.col("c0"), F.coalesce("c1", F.lit(""))).cast("float").alias("r_c_tset"), tset(F.col("a0"), F.coalesce("a1", F.lit(""))).cast("float").alias("r_a_tset"),
        F.coalesce((F.col("h0") == F.col("h1")) & (F.col("h0") != ""), F.lit(False)).cast("tinyint").alias("r_hn_eq"), F.col("ref_r").isNotNull().cast("tinyint").alias("has_ref"),
    )


def kind_flags(p: DataFrame) -> DataFrame:
    """k_<kind> from the bits of ``kinds``."""
    return p.select(*KEYS, *[(F.col("kinds").bitwiseAND(F.lit(b)) > 0).cast("tinyint").alias(f"k_{k}") for k, b in rules.KIND_BITS.items()])


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embedding_features(p: DataFrame) -> DataFrame:
    """e_name_cos and e_addr_cos of both sides' unit vectors ``name_vec`` and ``addr_vec``; null where one is missing."""
    return p.select(*KEYS, cosine(F.col("name_vec_1"), F.col("name_vec_2")).alias("e_name_cos"), cosine(F.col("addr_vec_1"), F.col("addr_vec_2")).alias("e_addr_cos"))


def idf_lookup(df: DataFrame, key: list[str], token_array: str, scope: list[str], idf: DataFrame, name: str) -> DataFrame:
    """Adds a map from each of the row's tokens to its idf, so that overlaps need no join a pair."""
    known = df.select(*key, *scope, F.explode(token_array).alias("t")).join(idf, [*scope, "t"])
    maps = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("t", "idf"))).alias(name))
    return df.join(maps, key, "left")


def idf_features(p: DataFrame, maps: str, prefix: str, miss: bool = False) -> DataFrame:
    """Weighted Jaccard and coverage of both sides' idf maps; null where a side has no tokens."""
    a, b = F.col(f"{maps}_1"), F.col(f"{maps}_2")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    shared = total(F.map_filter(a, lambda k, v: F.map_contains_key(b, k)))
    rows = p.withColumns({"__sa": total(a), "__sb": total(b), "__sh": shared})
    sa, sb, sh, least = F.col("__sa"), F.col("__sb"), F.col("__sh"), F.lit(1e-6)
    known = a.isNotNull() & b.isNotNull()
    cols = {f"{prefix}_jac": sh / F.greatest(sa + sb - sh, least), f"{prefix}_cov1": sh / F.greatest(sa, least), f"{prefix}_cov2": sh / F.greatest(sb, least)}
    if miss:
        odd = F.concat(F.map_values(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))), F.map_values(F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))))
        cols[f"{prefix}_miss"] = F.coalesce(F.array_max(odd), F.lit(0.0))
    return rows.select(*KEYS, *[F.when(known, v).alias(k) for k, v in cols.items()])


def bucket(n: Column) -> Column:
    """0, 1, 2, 3 for 3 to 5, 4 beyond; null stays null."""
    return F.when(n.isNull(), None).when(n <= 2, n).when(n <= 5, 3).otherwise(4).cast("tinyint")


def _counted(rows: DataFrame, by: list[str], where: Column, name: str, of: Column | None = None) -> DataFrame:
    """Adds the bucketed count of the rows of each row's group (or the sum of ``of`` over them), null where the condition fails.

    The groups are counted before the shuffle and met in a join, so no task holds all rows of one name.
    """
    n = rows.where(where).groupBy(*by).agg((F.count("*") if of is None else F.sum(of)).alias("__n"))
    n = n.select(*[F.col(c).alias(f"__{c}") for c in by], "__n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.join(n, same, "left").withColumn(name, bucket(F.when(where, F.col("__n")))).drop("__n", *[f"__{c}" for c in by])


def entity_counts(entities: DataFrame) -> DataFrame:
    """Adds bucketed counts of entities with the same name, building (hmain and rarest word ``ra``) and both; needs country, core, hmain, ra."""
    named, built = F.col("core") != "", (F.col("hmain") != "") & F.col("ra").isNotNull()
    out = _counted(entities, ["country", "core"], named, "a_s1_name")
    out = _counted(out, ["country", "hmain", "ra"], built, "a_s1_bldg")
    return _counted(out, ["country", "core", "hmain", "ra"], named & built, "a_s1_name_bldg")


def record_counts(records: DataFrame) -> DataFrame:
    """Adds bucketed counts of records with the same name, and of those without an address."""
    named, bare = F.col("core") != "", ((F.col("ad") == "") & (F.col("nums") == "")).cast("int")
    return _counted(_counted(records, ["country", "core"], named, "a_rec_name"), ["country", "core"], named, "a_rec_name_noaddr", bare)


def equality_flags(p: DataFrame) -> DataFrame:
    same = lambda x: ((F.col(f"{x}_1") == F.col(f"{x}_2")) & (F.col(f"{x}_1") != "")).cast("tinyint")
    return p.select(*KEYS, same("core").alias("core_eq"), same("cc").alias("cc_eq"))


def bucket_shares(df: DataFrame, column: str, split: str) -> DataFrame:
    """Share of each bucket within its country, for a comparison of two splits."""
    rows = df.groupBy("country", F.col(column).alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("country"))
    return rows.select(F.lit(split).alias("split"), F.lit(column).alias("feature"), "country", "bucket", share.alias("share"))


def share_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two splits' shares side by side, with the difference; missing shares are 0."""
    key = ["feature", "country", "bucket"]
    left = a.select(*key, F.col("share").alias("share_a"))
    right = b.select(*[F.col(k).alias(f"{k}_b") for k in key], F.col("share").alias("share_b"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in key]
    out = left.join(right, on, "full").select(*[F.coalesce(k, f"{k}_b").alias(k) for k in key], *[F.coalesce(s, F.lit(0.0)).alias(s) for s in ("share_a", "share_b")])
    return out.withColumn("shift", F.col("share_b") - F.col("share_a"))


def lookalike_features(p: DataFrame) -> DataFrame:
    """Unit, house-suffix and one-sided-name signals; needs units, hsuf, hmain, ct, at and ctdf (map of token to ln(1 + df)) of both sides."""
    c = F.col
    shared = F.size(F.array_intersect("units_1", "units_2"))
    n1, n2 = F.size("units_1"), F.size("units_2")
    h1, h2, s1, s2 = c("hmain_1"), c("hmain_2"), c("hsuf_1"), c("hsuf_2")
    house = (h1 == h2) & (h1 != "")
    one = lambda a, b: F.array_except(f"ct_{a}", f"ct_{b}")
    rare = lambda a, b: F.array_min(F.map_values(F.map_filter(f"ctdf_{a}", lambda k, v: F.array_contains(one(a, b), k))))
    flags = {
        "u_eq": shared > 0, "u_conf": (n1 > 0) & (n2 > 0) & (shared == 0), "hs_1": s1 != "", "hs_2": s2 != "", "hs_eq": s1 == s2,
        "hs_conf": house & (s1 != "") & (s2 != "") & (s1 != s2), "hs_one": house & ((s1 == "") != (s2 == "")),
        "h_pre": (h1 != h2) & (h1 != "") & (h2 != "") & (F.startswith(h1, h2) | F.startswith(h2, h1)),
        "x1_in_a2": F.arrays_overlap(one(1, 2), c("at_2")), "x2_in_a1": F.arrays_overlap(one(2, 1), c("at_1")),
    }
    distance = F.when((h1 != "") & (h2 != ""), F.levenshtein(h1, h2).cast("float"))
    return p.select(*KEYS, n1.alias("u_n1"), n2.alias("u_n2"), *[F.coalesce(v, F.lit(False)).cast("tinyint").alias(k) for k, v in flags.items()], distance.alias("h_lev"), rare(1, 2).alias("x1_df"), rare(2, 1).alias("x2_df"))
