"""Queries of tokens, keys, blocks, candidates and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.operators import blocking as B, features as X, tokens as T
from quillon.plans.registry import query, table
from quillon.plans.universe import REC, part_records, records
from quillon.scratch import Scratch

_GENERIC = ", ".join(f"'{x}'" for x in rules.ADDR_GENERIC)
_CAP = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.CAPS.items()) + " END"
_BIT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {rules.KIND_BITS[k]}" for k in rules.CAPS) + " END"

NAMES = """nt AS (SELECT DISTINCT id, src, country, unnest(string_split(core, ' ')) AS t FROM rec),
ndf AS (SELECT country, t, count(*) AS df FROM nt WHERE length(t) >= 2 GROUP BY ALL),
names AS (SELECT * FROM (SELECT id, src, country, t, df, row_number() OVER (PARTITION BY id, src ORDER BY df, t) AS place FROM nt JOIN ndf USING (country, t) WHERE df >= 2) WHERE place <= 3)"""
WORDS = f"""wt AS (SELECT DISTINCT id, src, country, unnest(string_split(ad, ' ')) AS t FROM rec),
wdf AS (SELECT country, t, count(*) AS df FROM wt WHERE length(t) >= 2 GROUP BY ALL),
words AS (SELECT * FROM (SELECT id, src, country, t, df, row_number() OVER (PARTITION BY id, src ORDER BY df, t) AS place FROM wt JOIN wdf USING (country, t) WHERE df >= 2 AND t NOT IN ({_GENERIC})) WHERE place <= 4)"""
NUMBERS = """nl AS (SELECT id, src, country, list_filter(string_split(nums, ' '), lambda x, i: x <> '' AND list_position(string_split(nums, ' '), x) = i) AS l FROM rec),
numbers AS (SELECT id, src, country, unnest(l[1:3]) AS n FROM nl)"""
_PAIR = "SELECT id, src, country, '{k}' AS kind, string_agg(t, '|' ORDER BY t) AS key FROM {f} WHERE place <= 2 GROUP BY id, src, country HAVING count(*) = 2"
KINDS = {
    "nw": "SELECT id, src, country, 'nw' AS kind, n || '|' || t AS key FROM numbers JOIN words USING (id, src, country)",
    "np": _PAIR.format(k="np", f="names"),
    "nt": f"SELECT id, src, country, 'nt' AS kind, t AS key FROM names WHERE place <= 2 AND df <= {rules.CAPS['nt']}",
    "cc": "SELECT id, src, country, 'cc' AS kind, replace(core, ' ', '') AS key FROM rec WHERE length(replace(core, ' ', '')) >= 6",
    "ap": _PAIR.format(k="ap", f="words"),
    "nn": "SELECT id, src, country, 'nn' AS kind, n || '|' || t AS key FROM numbers JOIN names USING (id, src, country) WHERE place <= 2",
    "hw": "SELECT id, src, country, 'hw' AS kind, hn || '|' || t AS key FROM rec JOIN words USING (id, src, country) WHERE contains(hn, '-')",
    "nr": f"SELECT id, src, country, 'nr' AS kind, t AS key FROM names JOIN rec USING (id, src, country) WHERE df <= {rules.CAPS['nr']} AND (src = 1 OR nums = '')",
}
KEYS = f"{REC}, {NAMES}, {WORDS}, {NUMBERS}, keys AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(KINDS.values()) + "))"
CAPPED = f"""{KEYS}, sizes AS (SELECT src, country, kind, key, count(*) AS n FROM keys GROUP BY ALL),
lk AS (SELECT id AS e, country, kind, key FROM keys JOIN sizes USING (src, country, kind, key) WHERE src = 1 AND n <= {rules.ENTITY_CAP}),
rk AS (SELECT src, id AS r, country, kind, key, n FROM keys JOIN sizes USING (src, country, kind, key) WHERE src > 1 AND n <= {_CAP})"""
PAIRS = f"""{CAPPED}, pairs AS (SELECT country, e, src, r, sum(1 / log2(1 + n)) AS pre, count(*) AS nk, bit_or({_BIT}) AS kinds,
  {", ".join(f"sum(CASE WHEN kind = '{k}' THEN 1 / log2(1 + n) ELSE 0 END) AS w_{k}" for k in rules.CAPS)}
  FROM lk JOIN rk USING (country, kind, key) GROUP BY country, e, src, r)"""
# ranks are taken on rounded evidence, so that sums in another order cannot swap ties
RANKED = f"{PAIRS}, ranked AS (SELECT * REPLACE (round(pre, 6) AS pre) FROM pairs)"
TRUE = "truth AS (SELECT a.id AS e, b.src, b.id AS r, a.country FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND md5(a.text) = md5(b.text))"


def _keys(rec):
    return B.keys(rec, scratch=Scratch(rec.sparkSession, "blocks"))


def _written(spark, sf_dir):
    """The records, parsed once for all branches of a query."""
    return Scratch(spark, "records").keep(records(spark, sf_dir), "records")


def _rounded(spark, sf_dir, rec=None):
    rec = records(spark, sf_dir) if rec is None else rec
    return B.union_evidence(*B.capped(_keys(rec))).withColumn("pre", F.round("pre", 6))


def _true(rec):
    rows = rec.select("id", "src", "country", F.md5("text").alias("h"))
    a, b = rows.where("src = 1").select(F.col("id").alias("e"), "country", "h"), rows.where("src > 1").select("src", F.col("id").alias("r"), "country", "h")
    return a.join(b, ["country", "h"]).select("e", "src", "r", "country")


def _plain(rec):
    return rec.withColumn("nt", T.tokens(F.col("core"))).withColumn("at", T.tokens(F.col("ad")))


@query(f"WITH {REC}, nt AS (SELECT DISTINCT id, country, unnest(string_split(core || ' ' || ad, ' ')) AS t FROM rec) SELECT t, CAST(count(*) AS BIGINT) AS df FROM nt WHERE length(t) >= 2 GROUP BY t")
def token_doc_freq(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("t", T.tokens(F.concat_ws(" ", "core", "ad"), 2))
    return T.document_frequency(rec, "t")


@query(f"WITH {REC}, {NAMES} SELECT id, CAST(place AS INT) AS place, t, CAST(df AS BIGINT) AS df FROM names")
def rarest_tokens(spark, sf_dir):
    return B.name_ranks(B.blocking_tokens(records(spark, sf_dir))).select("id", "place", "t", "df")


@query(f"WITH {REC}, wt AS (SELECT DISTINCT id, country, unnest(string_split(ad, ' ')) AS t FROM rec), n AS (SELECT country, count(*) AS n FROM rec GROUP BY country) SELECT country, t, round(ln(n / count(*)), 6) AS idf FROM wt JOIN n USING (country) WHERE t <> '' GROUP BY country, t, n")
def idf_by_group(spark, sf_dir):
    return T.idf(_plain(records(spark, sf_dir)), "at", ["country"]).withColumn("idf", F.round("idf", 6))


def _keys_query(kind, make):
    sql = f"WITH {REC}, {NAMES}, {WORDS}, {NUMBERS} SELECT DISTINCT id, country, key FROM ({KINDS[kind]})"

    def run(spark, sf_dir):
        rows = B.blocking_tokens(records(spark, sf_dir))
        return make(rows).select("id", "country", "key").distinct()

    run.__name__ = f"block_keys_{kind}"
    return query(sql)(run)


_cfg = B.LinkageConfig()
block_keys_nw = _keys_query("nw", lambda r: B.number_word_keys(r, B.word_ranks(r)))
block_keys_np = _keys_query("np", lambda r: B.pair_keys(B.name_ranks(r)))
block_keys_nt = _keys_query("nt", lambda r: B.single_keys(B.name_ranks(r), _cfg))
block_keys_cc = _keys_query("cc", B.compact_keys)
block_keys_ap = _keys_query("ap", lambda r: B.address_keys(B.word_ranks(r)))
block_keys_nn = _keys_query("nn", lambda r: B.number_name_keys(r, B.name_ranks(r)))
block_keys_hw = _keys_query("hw", lambda r: B.house_keys(r, B.word_ranks(r)))
block_keys_nr = _keys_query("nr", lambda r: B.rare_keys(r, B.name_ranks(r), _cfg))
KINDS["ca"] = "SELECT id, src, country, 'ca' AS kind, replace(core, ' ', '') || '|' || t AS key FROM rec JOIN words USING (id, src, country) WHERE place <= 2 AND length(replace(core, ' ', '')) >= 4"
block_keys_ca = _keys_query("ca", lambda r: B.compact_address_keys(r, B.word_ranks(r)))


@query(f"WITH {CAPPED} SELECT src, country, kind, CAST(count(*) AS BIGINT) AS keys, CAST(sum(n) AS BIGINT) AS rows_ FROM (SELECT DISTINCT src, country, kind, key, n FROM rk) GROUP BY ALL")
def block_cap_filter(spark, sf_dir):
    _, right = B.capped(_keys(records(spark, sf_dir)))
    return right.select("src", "country", "kind", "key", "n").distinct().groupBy("src", "country", "kind").agg(F.count("*").alias("keys"), F.sum("n").alias("rows_"))


_W = ", ".join(f"round(w_{k}, 6) AS w_{k}" for k in rules.CAPS)


@query(f"WITH {PAIRS} SELECT e, src, r, round(pre, 6) AS pre, CAST(nk AS INT) AS nk, CAST(kinds AS INT) AS kinds, {_W} FROM pairs")
def candidate_union(spark, sf_dir):
    pairs = B.union_evidence(*B.capped(_keys(records(spark, sf_dir))))
    return pairs.select("e", "src", "r", F.round("pre", 6).alias("pre"), "nk", "kinds", *[F.round(f"w_{k}", 6).alias(f"w_{k}") for k in rules.CAPS])


@query(f"WITH {RANKED} SELECT e, src, r, CAST(count(*) OVER w AS BIGINT) AS n_union, round(pre / max(pre) OVER w, 6) AS r_pre, CAST(row_number() OVER (PARTITION BY e, src ORDER BY pre DESC, r) AS INT) AS rk_pre FROM ranked WINDOW w AS (PARTITION BY e, src)")
def union_context(spark, sf_dir):
    return B.with_union_context(_rounded(spark, sf_dir)).select("e", "src", "r", "n_union", F.round("r_pre", 6).alias("r_pre"), "rk_pre")


@query(f"WITH {RANKED} SELECT e, src, r, pre FROM (SELECT *, row_number() OVER (PARTITION BY e, src ORDER BY pre DESC, r) AS k FROM ranked) WHERE k <= 15")
def topk_forward(spark, sf_dir):
    return B.top_forward(_rounded(spark, sf_dir), "pre", 15).select("e", "src", "r", "pre")


@query(f"WITH {RANKED} SELECT e, src, r, pre FROM (SELECT *, row_number() OVER (PARTITION BY src, r ORDER BY pre DESC, e) AS k FROM ranked) WHERE k <= 2")
def topk_reverse(spark, sf_dir):
    return B.top_reverse(_rounded(spark, sf_dir), "pre", 2).select("e", "src", "r", "pre")


@query(f"WITH {RANKED} SELECT e, src, r, pre FROM (SELECT *, row_number() OVER (PARTITION BY e, src ORDER BY pre DESC, r) AS k, row_number() OVER (PARTITION BY src, r ORDER BY pre DESC, e) AS q FROM ranked) WHERE k <= 5 OR q <= 1")
def topk_either(spark, sf_dir):
    return B.top_either(_rounded(spark, sf_dir), "pre", 5, 1).select("e", "src", "r", "pre")


@query(f"""WITH {RANKED}, c AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY pre DESC, src, r) AS rank1 FROM ranked),
t AS (SELECT e, max(CASE WHEN rank1 = 1 THEN src END) AS s1, max(CASE WHEN rank1 = 1 THEN r END) AS i1, max(CASE WHEN rank1 = 2 THEN src END) AS s2, max(CASE WHEN rank1 = 2 THEN r END) AS i2 FROM c GROUP BY e)
SELECT c.e, src, r, CAST(rank1 AS INT) AS rank1, CAST(row_number() OVER (PARTITION BY c.e, src ORDER BY pre DESC, r) AS INT) AS rank1s, round(pre / max(pre) OVER (PARTITION BY c.e), 6) AS rel1,
 CAST(row_number() OVER (PARTITION BY src, r ORDER BY pre DESC, c.e) AS INT) AS rank2, round(pre / max(pre) OVER (PARTITION BY src, r), 6) AS rel2, count(*) OVER (PARTITION BY src, r) AS n2,
 CASE WHEN rank1 = 1 THEN s2 ELSE s1 END AS ref_src, CASE WHEN rank1 = 1 THEN i2 ELSE i1 END AS ref_r FROM c JOIN t ON c.e = t.e""")
def candidate_context(spark, sf_dir):
    out = X.context(_rounded(spark, sf_dir))
    return out.select("e", "src", "r", "rank1", "rank1s", F.round("rel1", 6).alias("rel1"), "rank2", F.round("rel2", 6).alias("rel2"), "n2", "ref_src", "ref_r")


_TOP = f"{RANKED}, top AS (SELECT e, src, r FROM (SELECT *, row_number() OVER (PARTITION BY e, src ORDER BY pre DESC, r) AS k FROM ranked) WHERE k <= 15)"
_SETS = "sets AS (SELECT id, src, country, core, ad, nums, list_distinct(list_filter(string_split(core, ' '), lambda x: x <> '')) AS ct, list_distinct(list_filter(string_split(ad, ' '), lambda x: x <> '')) AS at, list_distinct(list_filter(string_split(nums, ' '), lambda x: x <> '')) AS nt FROM rec)"


def _top_pairs(spark, sf_dir, rec=None):
    return B.top_forward(_rounded(spark, sf_dir, rec), "pre", 15).select("e", "src", "r")


def _sided(rec):
    """Records with all the columns that pair features read."""
    rec = rec.withColumns({"ct": T.tokens(F.col("core")), "at": T.tokens(F.col("ad")), "nt": T.tokens(F.col("nums"))})
    rec = rec.withColumns({"nm": F.col("core"), "adf": F.col("ad"), "legal": F.lit(""), "script": F.lit(0).cast("tinyint"), "web": F.col("text").contains("www.").cast("tinyint"), "hmain": F.coalesce(F.get("nt", F.lit(0)), F.lit(""))})
    rec = T.with_rarest(rec, ["id", "src"], "ct", T.document_frequency(rec, "ct"), "rc")
    return T.with_rarest(rec, ["id", "src"], "at", T.document_frequency(rec, "at"), "ra", rules.ADDR_GENERIC)


_SIDE = ["core", "ad", "adf", "nm", "cc", "nums", "hn", "hmain", "legal", "script", "web", "ct", "at", "nt", "rc", "rc_df", "ra", "ra_df"]


@query(f"""WITH {_TOP}, {_SETS}, j AS (SELECT e, p.src, r, a.ct AS c1, b.ct AS c2, a.at AS a1, b.at AS a2, a.nt AS n1, b.nt AS n2 FROM top p JOIN sets a ON a.id = e AND a.src = 1 JOIN sets b ON b.id = r AND b.src = p.src)
SELECT e, src, r, CAST(len(list_intersect(c1, c2)) AS INT) AS c_inter, CAST(len(c1) + len(c2) - len(list_intersect(c1, c2)) AS INT) AS c_union, CAST(len(c1) - len(list_intersect(c1, c2)) AS INT) AS c_only1, CAST(len(c2) - len(list_intersect(c1, c2)) AS INT) AS c_only2,
 CAST(len(list_intersect(a1, a2)) AS INT) AS a_inter, CAST(len(list_intersect(n1, n2)) AS INT) AS n_inter,
 round(len(list_intersect(c1, c2)) / greatest(len(c1) + len(c2) - len(list_intersect(c1, c2)), 1), 6) AS c_jac, round(len(list_intersect(a1, a2)) / greatest(len(a1) + len(a2) - len(list_intersect(a1, a2)), 1), 6) AS a_jac FROM j""")
def set_overlap_features(spark, sf_dir):
    rec = _written(spark, sf_dir)
    out = X.set_features(X.attach(_top_pairs(spark, sf_dir, rec), _sided(rec), _SIDE))
    return out.select("e", "src", "r", "c_inter", "c_union", "c_only1", "c_only2", "a_inter", "n_inter", F.round("c_jac", 6).alias("c_jac"), F.round("a_jac", 6).alias("a_jac"))


@query()
def pair_features_all(spark, sf_dir):
    """Every feature group of all candidates among parts that a run keeps; the string scores have no SQL twin."""
    parts = part_records(spark, sf_dir)
    rec = _sided(parts)
    scratch = Scratch(spark, "features")
    found = X.context(B.union_evidence(*B.capped(_keys(parts))).withColumn("pre", F.round("pre", 6)))
    pairs = scratch.keep(found.where("rank1s <= 15"), "pairs")
    p = scratch.keep(X.attach(pairs, rec, _SIDE), "sides")
    return X.set_features(p).join(X.fuzzy_features(p), X.KEYS).join(X.kind_flags(pairs), X.KEYS).join(X.reference_features(pairs, rec), X.KEYS)


@query(f"""WITH {_TOP}, {_SETS}, n AS (SELECT country, count(*) AS n FROM rec GROUP BY country), i AS (SELECT country, t, ln(n / count(*)) AS idf FROM (SELECT country, unnest(ct) AS t FROM sets) JOIN n USING (country) GROUP BY country, t, n),
x AS (SELECT e, p.src, r, country, unnest(ct) AS t FROM top p JOIN sets s ON s.id = e AND s.src = 1), y AS (SELECT e, p.src, r, country, unnest(ct) AS t FROM top p JOIN sets s ON s.id = r AND s.src = p.src),
sa AS (SELECT e, src, r, sum(idf) AS sa FROM x JOIN i USING (country, t) GROUP BY ALL), sb AS (SELECT e, src, r, sum(idf) AS sb FROM y JOIN i USING (country, t) GROUP BY ALL),
sh AS (SELECT e, src, r, sum(idf) AS sh FROM x JOIN y USING (e, src, r, country, t) JOIN i USING (country, t) GROUP BY ALL),
odd AS (SELECT e, src, r, max(idf) AS miss FROM (SELECT * FROM x ANTI JOIN y USING (e, src, r, country, t) UNION ALL SELECT * FROM y ANTI JOIN x USING (e, src, r, country, t)) JOIN i USING (country, t) GROUP BY ALL)
SELECT e, src, r, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN round(coalesce(sh, 0) / greatest(sa + sb - coalesce(sh, 0), 1e-6), 6) END AS idf_name_jac,
 CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN round(coalesce(sh, 0) / greatest(sa, 1e-6), 6) END AS idf_name_cov1, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN round(coalesce(sh, 0) / greatest(sb, 1e-6), 6) END AS idf_name_cov2,
 CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN round(coalesce(miss, 0), 6) END AS idf_name_miss
FROM top LEFT JOIN sa USING (e, src, r) LEFT JOIN sb USING (e, src, r) LEFT JOIN sh USING (e, src, r) LEFT JOIN odd USING (e, src, r)""")
def idf_overlap_features(spark, sf_dir):
    plain = _written(spark, sf_dir)
    rec = plain.withColumn("ct", T.tokens(F.col("core")))
    rec = X.idf_lookup(rec, ["id", "src"], "ct", ["country"], T.idf(rec, "ct", ["country"]), "weights")
    out = X.idf_features(X.attach(_top_pairs(spark, sf_dir, plain), rec, ["weights"]), "weights", "idf_name", miss=True)
    return out.select("e", "src", "r", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("idf")])


@query(f"""WITH {RANKED}, {TRUE}, h AS (SELECT t.country, t.e, count(*) AS n, count(p.e) AS found FROM truth t LEFT JOIN ranked p USING (e, src, r) GROUP BY t.country, t.e)
SELECT country, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(found) AS BIGINT) AS found, round(sum(found) / sum(n), 6) AS recall, round(avg(CAST(found = n AS DOUBLE)), 6) AS all_found FROM h GROUP BY country""")
def recall_report(spark, sf_dir):
    out = B.recall(_rounded(spark, sf_dir), _true(records(spark, sf_dir)), ["country"])
    return out.select("country", "pairs", "found", F.round("recall", 6).alias("recall"), F.round("all_found", 6).alias("all_found"))


@query(f"WITH {RANKED}, {TRUE}, more AS (SELECT * FROM truth UNION SELECT a.id, b.src, b.id, a.country FROM rec a JOIN rec b ON a.src = 1 AND b.id = a.id + 1 AND b.country = a.country) SELECT e, src, r, country FROM more ANTI JOIN ranked USING (e, src, r)")
def anti_missed_pairs(spark, sf_dir):
    """Equal texts as true pairs, and neighbouring ids of one country, of which most share no key."""
    rec = records(spark, sf_dir)
    one, two = rec.where("src = 1").select(F.col("id").alias("e"), "country"), rec.where("src > 1").select("src", F.col("id").alias("r"), "country")
    next_ = one.withColumn("r", F.col("e") + 1).join(two, ["country", "r"]).select("e", "src", "r", "country")
    return B.missed(_rounded(spark, sf_dir), _true(rec).union(next_).distinct()).select("e", "src", "r", "country")


@query(f"WITH {RANKED}, {TRUE} SELECT coalesce(p.e, t.e) AS e, coalesce(p.src, t.src) AS src, coalesce(p.r, t.r) AS r, coalesce(pre, 0) AS pre, CAST(coalesce(kinds, 0) | CASE WHEN t.e IS NULL THEN 0 ELSE 256 END AS INT) AS kinds FROM ranked p FULL JOIN truth t ON p.e = t.e AND p.src = t.src AND p.r = t.r")
def full_outer_union(spark, sf_dir):
    return B.merge_candidates(_rounded(spark, sf_dir), _true(records(spark, sf_dir))).select("e", "src", "r", "pre", "kinds")


_BUCKET = "CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 2 THEN {x} WHEN {x} <= 5 THEN 3 ELSE 4 END"


@query(f"SELECT c_custkey, CAST({_BUCKET.format(x='n1')} AS TINYINT) AS a_s1_name, CAST({_BUCKET.format(x='n2')} AS TINYINT) AS a_s1_bldg, CAST({_BUCKET.format(x='n3')} AS TINYINT) AS a_s1_name_bldg FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n1, count(*) OVER (PARTITION BY c_nationkey, c_custkey // 7, c_custkey % 5) AS n2, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey // 7, c_custkey % 5) AS n3 FROM customer)")
def name_counts_bucketed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("core"), F.floor(F.col("c_custkey") / 7).cast("string").alias("hmain"), (F.col("c_custkey") % 5).cast("string").alias("ra"))
    return X.entity_counts(rows).select("c_custkey", "a_s1_name", "a_s1_bldg", "a_s1_name_bldg")


@query(f"SELECT p_partkey, CAST({_BUCKET.format(x='n1')} AS TINYINT) AS a_rec_name, CAST({_BUCKET.format(x='n2')} AS TINYINT) AS a_rec_name_noaddr FROM (SELECT p_partkey, count(*) OVER w AS n1, sum(CAST(p_size % 4 = 0 AS INT)) OVER w AS n2 FROM part WINDOW w AS (PARTITION BY p_brand, p_name))")
def record_counts_bucketed(spark, sf_dir):
    empty = F.when(F.col("p_size") % 4 == 0, "").otherwise("x")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("country"), F.col("p_name").alias("core"), empty.alias("ad"), empty.alias("nums"))
    return X.record_counts(rows).select("p_partkey", "a_rec_name", "a_rec_name_noaddr")


@query("""WITH s AS (SELECT c_custkey % 2 AS h, c_nationkey AS country, c_mktsegment AS bucket, count(*) AS n FROM customer GROUP BY ALL), q AS (SELECT h, country, bucket, n / sum(n) OVER (PARTITION BY h, country) AS share FROM s),
a AS (SELECT * FROM q WHERE h = 0), b AS (SELECT * FROM q WHERE h = 1)
SELECT coalesce(a.country, b.country) AS country, coalesce(a.bucket, b.bucket) AS bucket, round(coalesce(a.share, 0), 6) AS share_a, round(coalesce(b.share, 0), 6) AS share_b FROM a FULL JOIN b ON a.country = b.country AND a.bucket = b.bucket""")
def bucket_share_shift(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("country"), "c_mktsegment")
    half = lambda h: X.bucket_shares(c.where(F.col("c_custkey") % 2 == h), "c_mktsegment", str(h))
    out = X.share_shift(half(0), half(1))
    return out.select("country", "bucket", F.round("share_a", 6).alias("share_a"), F.round("share_b", 6).alias("share_b"))
