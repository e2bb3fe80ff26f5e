"""Queries of owners, prefixes, metrics, collective views and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import collective as C, decode as D, evaluate as E, models as M
from quillon.plans.registry import query, table
from quillon.plans.universe import SCORED, scored, truth

OWNED = f"{SCORED}, owned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, r ORDER BY p DESC, e) AS place FROM scored) WHERE place = 1)"


def _ranked(source, name="rk"):
    return f"""{name} AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (PARTITION BY e ORDER BY p DESC, src, r ROWS UNBOUNDED PRECEDING) AS ctp, sum(y) OVER (PARTITION BY e ORDER BY p DESC, src, r ROWS UNBOUNDED PRECEDING) AS cy,
  sum(p) OVER (PARTITION BY e) AS psum, max(p) OVER (PARTITION BY e) AS pmax FROM {source} WINDOW o AS (PARTITION BY e ORDER BY p DESC, src, r))"""


def _chosen(ts, tm, mm, source="rk", name="ch"):
    return f"{name} AS (SELECT e, k, cy FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY 1.25 * ctp / (0.25 * (psum + {mm}) + k) DESC, k) AS z FROM {source} WHERE pmax >= {ts} AND p >= {tm}) WHERE z = 1)"


_OUT = """oc AS (SELECT t.e, t.country, CAST(n_true AS DOUBLE) AS n_true, coalesce(n_ct, 0) AS n_ct, coalesce(ch.k, 0) AS k, coalesce(ch.cy, 0) AS tp FROM truth t LEFT JOIN (SELECT e, sum(y) AS n_ct FROM scored GROUP BY e) c ON c.e = t.e LEFT JOIN ch ON ch.e = t.e),
o AS (SELECT *, CASE WHEN n_true = 0 THEN CAST(k = 0 AS DOUBLE) WHEN k = 0 THEN 0 ELSE 1.25 * tp / (0.25 * n_true + k) END AS f,
  CASE WHEN tp > 0 THEN 1.25 * tp / (0.25 * n_true + tp) ELSE 0 END AS fa, CASE WHEN n_ct > 0 THEN 1.25 * n_ct / (0.25 * n_true + n_ct) ELSE 0 END AS fb FROM oc)"""
_PARTS = """round(avg(f), 6) AS f05, round(avg(CAST(n_true = 0 AND k > 0 AS INT)), 6) AS singleton_merged, round(avg(CAST(n_true > 0 AND k = 0 AND n_ct > 0 AS INT)), 6) AS emptied_findable,
 round(avg(CAST(n_true > 0 AND k = 0 AND n_ct = 0 AS INT)), 6) AS emptied_lost, round(avg(CASE WHEN n_true > 0 AND k > 0 THEN fa - f ELSE 0 END), 6) AS false_pairs,
 round(avg(CASE WHEN n_true > 0 AND k > 0 THEN fb - fa ELSE 0 END), 6) AS missed_candidates, round(avg(CASE WHEN n_true > 0 AND k > 0 THEN 1 - fb ELSE 0 END), 6) AS lost_candidates,
 CAST(sum(k - tp) AS BIGINT) AS wrong_pairs, CAST(sum(tp) AS BIGINT) AS correct_pairs"""
_NAMES = ("f05", "singleton_merged", "emptied_findable", "emptied_lost", "false_pairs", "missed_candidates", "lost_candidates")
BASE = f"{OWNED}, {_ranked('owned')}, {_chosen(0.5, 0.3, 0.05)}"


def _both(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return pairs, truth(spark, sf_dir, pairs)


def _parts(df, *by):
    return df.select(*by, *[F.round(n, 6).alias(n) for n in _NAMES], "wrong_pairs", "correct_pairs")


@query(f"WITH {OWNED} SELECT e, src, r, p FROM owned")
def one_owner(spark, sf_dir):
    return D.one_owner(scored(spark, sf_dir)).select("e", "src", "r", "p")


@query(f"WITH {BASE} SELECT rk.e, src, r, p, CAST(rk.k AS INT) AS k FROM rk JOIN ch ON ch.e = rk.e WHERE rk.k <= ch.k")
def decode_prefix(spark, sf_dir):
    return D.decode(scored(spark, sf_dir))


_THR = "thr AS (SELECT * FROM (VALUES ('1-URGENT', 0.6, 0.2, 0.3), ('2-HIGH', 0.6, 0.3, 0.34), ('_default', 0.65, 0.3, 0.34)) v(country, t_single, t_match, miss_mass))"


@query(f"""WITH {OWNED}, {_THR}, oc AS (SELECT o.*, coalesce(a.t_single, d.t_single) AS ts, coalesce(a.t_match, d.t_match) AS tm, coalesce(a.miss_mass, d.miss_mass) AS mm FROM owned o JOIN truth t ON t.e = o.e LEFT JOIN thr a ON a.country = t.country JOIN thr d ON d.country = '_default'),
{_ranked('oc')}, {_chosen('ts', 'tm', 'mm')} SELECT rk.e, src, r, CAST(rk.k AS INT) AS k FROM rk JOIN ch ON ch.e = rk.e WHERE rk.k <= ch.k""")
def decode_by_country(spark, sf_dir):
    from quillon.sources.files import thresholds

    pairs, t = _both(spark, sf_dir)
    table_ = thresholds(spark, {"1-URGENT": {"t_single": 0.6, "t_match": 0.2, "miss_mass": 0.3}, "2-HIGH": {"t_single": 0.6, "t_match": 0.3, "miss_mass": 0.34}, "_default": {"t_single": 0.65, "t_match": 0.3, "miss_mass": 0.34}})
    return D.decode(pairs.join(t.select("e", "country"), "e"), thresholds=table_).select("e", "src", "r", "k")


@query(f"WITH {BASE}, {_OUT} SELECT country, round(avg(f), 6) AS f05, count(*) AS entities FROM o GROUP BY country")
def f05_macro(spark, sf_dir):
    pairs, t = _both(spark, sf_dir)
    out = D.outcomes(D.decode(pairs), pairs, t).join(t.select("e", "country"), "e")
    return out.groupBy("country").agg(F.round(F.avg("f"), 6).alias("f05"), F.count("*").alias("entities"))


@query(f"WITH {BASE}, {_OUT} SELECT country, {_PARTS} FROM o GROUP BY country")
def loss_decompose(spark, sf_dir):
    pairs, t = _both(spark, sf_dir)
    return _parts(D.decompose(D.outcomes(D.decode(pairs), pairs, t).join(t.select("e", "country"), "e"), ("country",)), "country")


def _variant(name, ts, tm, mm, source):
    return f"SELECT '{name}' AS variant, {_PARTS} FROM (WITH {_ranked(source)}, {_chosen(ts, tm, mm)}, {_OUT} SELECT * FROM o)"


@query(f"WITH {OWNED} " + " UNION ALL ".join([_variant("full", 0.5, 0.3, 0.05, "owned"), _variant("no singleton gate", 0.0, 0.3, 0.05, "owned"), _variant("no minimum p", 0.5, 0.0, 0.05, "owned"), _variant("no missed-match prior", 0.5, 0.3, 0.0, "owned"), _variant("no one-owner", 0.5, 0.3, 0.05, "scored")]))
def decoder_ablation(spark, sf_dir):
    pairs, t = _both(spark, sf_dir)
    return _parts(D.ablate(pairs, pairs, t), "variant")


@query(f"WITH {SCORED}, c AS (SELECT t.e, n_true, coalesce(n_ct, 0) AS n_ct FROM truth t LEFT JOIN (SELECT e, sum(y) AS n_ct FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, r ORDER BY y DESC, e) AS z FROM scored) WHERE z = 1) GROUP BY e) c ON c.e = t.e), a AS (SELECT t.e, n_true, coalesce(n_ct, 0) AS n_ct FROM truth t LEFT JOIN (SELECT e, sum(y) AS n_ct FROM scored GROUP BY e) c ON c.e = t.e) SELECT (SELECT round(avg(CASE WHEN n_true = 0 THEN 1 WHEN n_ct = 0 THEN 0 ELSE 1.25 * n_ct / (0.25 * n_true + n_ct) END), 6) FROM c) AS decoded, (SELECT round(avg(CASE WHEN n_true = 0 THEN 1 WHEN n_ct = 0 THEN 0 ELSE 1.25 * n_ct / (0.25 * n_true + n_ct) END), 6) FROM a) AS direct")
def perfect_ceiling(spark, sf_dir):
    """A record has several true entities here, so the owner step costs the decoded figure what the direct one keeps."""
    pairs, t = _both(spark, sf_dir)
    return D.ceiling(pairs, t).select(F.round("decoded", 6).alias("decoded"), F.round("direct", 6).alias("direct"))


_POINTS = [(a, b, c) for a in D.GRID["t_single"] for b in D.GRID["t_match"] for c in D.GRID["miss_mass"] if b <= a]
_GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in _POINTS) + ") v(t_single, t_match, miss_mass))"
_GRIDDED = f"""{OWNED}, {_ranked('owned')}, {_GRID}, z AS (SELECT *, row_number() OVER (PARTITION BY t_single, t_match, miss_mass, e ORDER BY 1.25 * ctp / (0.25 * (psum + miss_mass) + k) DESC, k) AS best FROM rk JOIN g ON pmax >= t_single AND p >= t_match),
s AS (SELECT country, t_single, t_match, miss_mass, sum(CASE WHEN n_true = 0 THEN 0 ELSE 1.25 * cy / (0.25 * n_true + k) END) AS s, sum(CAST(n_true = 0 AS INT)) AS lost FROM z JOIN truth USING (e) WHERE best = 1 GROUP BY ALL),
b AS (SELECT country, count(*) AS n, sum(CAST(n_true = 0 AS INT)) AS empty FROM truth GROUP BY country),
gr AS (SELECT b.country, g.t_single, g.t_match, g.miss_mass, round((coalesce(s, 0) + empty - coalesce(lost, 0)) / n, 6) AS f05 FROM b CROSS JOIN g LEFT JOIN s ON s.country = b.country AND s.t_single = g.t_single AND s.t_match = g.t_match AND s.miss_mass = g.miss_mass)"""


@query(f"WITH {_GRIDDED} SELECT country, CAST(t_single AS DOUBLE) AS t_single, CAST(t_match AS DOUBLE) AS t_match, CAST(miss_mass AS DOUBLE) AS miss_mass, f05 FROM gr")
def threshold_grid(spark, sf_dir):
    pairs, t = _both(spark, sf_dir)
    return D.threshold_grid(pairs, t, by="country").withColumn("f05", F.round("f05", 6))


@query(f"WITH {_GRIDDED}, best AS (SELECT country, t_single, t_match, miss_mass FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY f05 DESC, t_single DESC, t_match DESC, miss_mass DESC) AS z FROM gr) WHERE z = 1) SELECT country, CAST(t_single AS DOUBLE) AS t_single, CAST(t_match AS DOUBLE) AS t_match, CAST(miss_mass AS DOUBLE) AS miss_mass FROM best UNION ALL SELECT '_default', CAST(max(t_single) AS DOUBLE), CAST(max(t_match) AS DOUBLE), CAST(max(miss_mass) AS DOUBLE) FROM best")
def threshold_tune(spark, sf_dir):
    pairs, t = _both(spark, sf_dir)
    return D.tune(D.threshold_grid(pairs, t, by="country").withColumn("f05", F.round("f05", 6)), "country")


_HALVES = f"""{OWNED}, {_ranked('owned')}, {_GRID}, z AS (SELECT *, row_number() OVER (PARTITION BY t_single, t_match, miss_mass, e ORDER BY 1.25 * ctp / (0.25 * (psum + miss_mass) + k) DESC, k) AS best FROM rk JOIN g ON pmax >= t_single AND p >= t_match),
s AS (SELECT country, truth.e % 2 AS fold, t_single, t_match, miss_mass, sum(CASE WHEN n_true = 0 THEN 0 ELSE 1.25 * cy / (0.25 * n_true + k) END) AS s, sum(CAST(n_true = 0 AS INT)) AS lost FROM z JOIN truth USING (e) WHERE best = 1 GROUP BY ALL),
b AS (SELECT country, e % 2 AS fold, count(*) AS n, sum(CAST(n_true = 0 AS INT)) AS empty FROM truth GROUP BY ALL),
gr AS (SELECT b.country, b.fold, g.t_single, g.t_match, g.miss_mass, n, round((coalesce(s, 0) + empty - coalesce(lost, 0)) / n, 9) AS f05 FROM b CROSS JOIN g LEFT JOIN s ON s.country = b.country AND s.fold = b.fold AND s.t_single = g.t_single AND s.t_match = g.t_match AND s.miss_mass = g.miss_mass),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, fold ORDER BY f05 DESC, t_single DESC, t_match DESC, miss_mass DESC) AS q FROM gr) WHERE q = 1)"""


@query(f"WITH {_HALVES} SELECT gr.country, CAST(gr.fold AS INT) AS fold, round(gr.f05, 6) AS f05, gr.n AS entities FROM gr JOIN best b ON b.country = gr.country AND b.fold = 1 - gr.fold AND b.t_single = gr.t_single AND b.t_match = gr.t_match AND b.miss_mass = gr.miss_mass")
def honest_thresholds(spark, sf_dir):
    """Thresholds tuned on the even or odd orders and scored on the others."""
    pairs, t = _both(spark, sf_dir)
    return D.honest(pairs, t, (F.col("e") % 2).cast("int"), "country").withColumn("f05", F.round("f05", 6))


@query(f"""WITH {SCORED}, v AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY p DESC, src, r) AS p_rank, max(p) OVER (PARTITION BY e) AS p_max, count(*) OVER (PARTITION BY e) AS n_cand, sum(CAST(p >= 0.5 AS INT)) OVER (PARTITION BY e) AS n_hi, sum(p) OVER (PARTITION BY e) AS p_sum,
 row_number() OVER (PARTITION BY e, src ORDER BY p DESC, r) AS p_rank_s, sum(CAST(p >= 0.5 AS INT)) OVER (PARTITION BY e, src) AS n_hi_s, count(*) OVER (PARTITION BY src, r) AS r_n, max(p) OVER (PARTITION BY src, r) AS rmax,
 nth_value(p, 2) OVER (PARTITION BY e ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e2, nth_value(p, 2) OVER (PARTITION BY src, r ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r2 FROM scored),
w AS (SELECT *, CASE WHEN n_cand = 1 THEN -1 WHEN p_rank = 1 THEN coalesce(e2, p_max) ELSE p_max END AS p_other, CASE WHEN r_n = 1 THEN -1 WHEN p >= rmax THEN coalesce(r2, rmax) ELSE rmax END AS p_rival FROM v)
SELECT e, src, r, CAST(p_rank AS INT) AS p_rank, p_max, n_cand, CAST(n_hi AS BIGINT) AS n_hi, round(p_sum, 6) AS p_sum, CAST(p_rank_s AS INT) AS p_rank_s, CAST(n_hi_s AS BIGINT) AS n_hi_s, r_n, round(p - p_max, 6) AS p_gap, round(p_other, 6) AS p_other, round(p_rival, 6) AS p_rival, round(p - p_rival, 6) AS p_rival_gap FROM w""")
def collective_views(spark, sf_dir):
    v = C.views(scored(spark, sf_dir))
    six = lambda c: F.round(c, 6).alias(c)
    return v.select("e", "src", "r", "p_rank", "p_max", "n_cand", "n_hi", six("p_sum"), "p_rank_s", "n_hi_s", "r_n", six("p_gap"), six("p_other"), six("p_rival"), six("p_rival_gap"))


@query(f"WITH {SCORED} SELECT e, src, r, p, round(p * 0.8 + 0.1, 6) AS p_second, round((p + round(p * 0.8 + 0.1, 6)) / 2, 6) AS blended FROM scored WHERE p > 0.2 AND p < 0.8")
def band_blend(spark, sf_dir):
    pairs = C.band(scored(spark, sf_dir), 0.2)
    second = pairs.select("e", "src", "r", F.round(F.col("p") * 0.8 + 0.1, 6).alias("p"))
    out = C.blend(pairs, second)
    return out.select("e", "src", "r", F.col("p_first").alias("p"), "p_second", F.round("p", 6).alias("blended"))


@query(f"""WITH {SCORED}, b AS (SELECT e, src, r, round(1 - abs(2 * p - 1), 6) AS ce FROM scored WHERE p > 0.2 AND p < 0.8), w AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY ce DESC, src, r) AS ce_rank, count(*) OVER (PARTITION BY e) AS ce_n, ce - max(ce) OVER (PARTITION BY e) AS gap, count(*) OVER (PARTITION BY src, r) AS n, max(ce) OVER (PARTITION BY src, r) AS m,
 nth_value(ce, 2) OVER (PARTITION BY src, r ORDER BY ce DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m2 FROM b)
SELECT s.e, s.src, s.r, ce, CAST(ce_rank AS INT) AS ce_rank, ce_n, round(gap, 6) AS ce_gap, round(CASE WHEN n = 1 THEN -1 WHEN ce >= m THEN coalesce(m2, m) ELSE m END, 6) AS ce_rival FROM scored s LEFT JOIN w ON w.e = s.e AND w.src = s.src AND w.r = s.r""")
def band_rescore(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    ce = C.band(pairs, 0.2).select("e", "src", "r", F.round(1 - F.abs(2 * F.col("p") - 1), 6).alias("ce"))
    out = C.band_features(pairs, ce)
    return out.select("e", "src", "r", "ce", "ce_rank", "ce_n", F.round("ce_gap", 6).alias("ce_gap"), F.round("ce_rival", 6).alias("ce_rival"))


_CAL = "SELECT *, CAST(quality AS INT) AS y, (doc_id * 7919 % 1000) / 1000.0 AS p FROM labels"


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p"))


@query(f"WITH l AS ({_CAL}), s AS (SELECT toxic, count(*) AS pairs, round(avg(y), 6) AS true_rate, round(avg(p), 6) AS mean_p, round(avg(p - y), 6) AS gap, round(avg((p - y) * (p - y)), 6) AS brier, round(sum(CAST(y = 1 AND p >= 0.5 AS INT)) / nullif(sum(y), 0), 6) AS recall05, CAST(sum(CAST(y = 1 AND p < 0.5 AS INT)) AS BIGINT) AS missed FROM l GROUP BY toxic) SELECT *, round(missed / nullif(sum(missed) OVER (), 0), 6) AS share_missed FROM s")
def calibration_strata(spark, sf_dir):
    out = E.calibration(_labelled(spark, sf_dir), ["toxic"])
    return out.select("toxic", "pairs", *[F.round(c, 6).alias(c) for c in ("true_rate", "mean_p", "gap", "brier", "recall05")], "missed", F.round("share_missed", 6).alias("share_missed"))


@query(f"WITH l AS ({_CAL}), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM l) SELECT round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, count(*) AS rows_ FROM r")
def auc_by_rank(spark, sf_dir):
    return E.auc(_labelled(spark, sf_dir)).select(F.round("auc", 6).alias("auc"), F.col("rows").alias("rows_"))


@query(f"WITH {SCORED} SELECT e, src, r, round(1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) - 0.5))), 6) AS shifted FROM scored")
def logit_shift(spark, sf_dir):
    return scored(spark, sf_dir).select("e", "src", "r", F.round(D.shift(F.col("p"), -0.5), 6).alias("shifted"))


@query(f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY p DESC, src, r) AS z FROM scored) SELECT e, src, r, p FROM k WHERE p >= 0.4 OR z = 1")
def metablock_prune(spark, sf_dir):
    return M.prune(scored(spark, sf_dir), "p", 0.4).select("e", "src", "r", "p")


@query(f"WITH {BASE}, said AS (SELECT rk.e, src, r FROM rk JOIN ch ON ch.e = rk.e WHERE rk.k <= ch.k), tp AS (SELECT e, src, r FROM scored WHERE y = 1), owners AS (SELECT DISTINCT e FROM tp) SELECT e, src, r, 'FP' AS error, CASE WHEN o.e IS NULL THEN 'singleton trap' ELSE 'wrong merge' END AS reason FROM (SELECT * FROM said ANTI JOIN tp USING (e, src, r)) s LEFT JOIN owners o USING (e) UNION ALL SELECT e, src, r, 'FN', 'model low' FROM tp ANTI JOIN said USING (e, src, r)")
def error_dump(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return D.errors(D.decode(pairs), pairs, pairs.where("y = 1"))


@query(f"WITH {BASE}, said AS (SELECT rk.e, r, rk.k FROM rk JOIN ch ON ch.e = rk.e WHERE rk.k <= ch.k) SELECT o_orderkey AS place, CAST(o_orderkey AS VARCHAR) AS entity_id, coalesce(l, '') AS matched_entity_ids FROM orders LEFT JOIN (SELECT e, string_agg(CAST(r AS VARCHAR), ',' ORDER BY k) AS l FROM said GROUP BY e) ON e = o_orderkey")
def id_lists(spark, sf_dir):
    from quillon.sources.files import id_lists as lists

    chosen = D.decode(scored(spark, sf_dir)).select(F.col("e").cast("string").alias("entity_id"), F.col("r").cast("string").alias("id"), F.col("k").alias("rank"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("entity_id"))
    return lists(orders, chosen)


@query("WITH w AS (SELECT * FROM (VALUES ('1-URGENT', 0.45), ('2-HIGH', 0.55)) v(country, w)), f AS (SELECT o_orderpriority AS country, avg(o_totalprice) AS f05 FROM orders GROUP BY 1) SELECT round(sum(w * f05) / sum(w), 2) AS f05, count(*) AS groups FROM f JOIN w USING (country)")
def weighted_score(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("country")).agg(F.avg("o_totalprice").alias("f05"))
    return E.weighted_mean(rows, {"1-URGENT": 0.45, "2-HIGH": 0.55}).select(F.round("f05", 2).alias("f05"), "groups")


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 1000 + c_custkey % 7 * 100 + c_nationkey // 6 AS b FROM customer), v AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(id, m) AS (SELECT DISTINCT a, a FROM v UNION SELECT v.b, c.m FROM c JOIN v ON v.a = c.id) SELECT CAST(id AS BIGINT) AS id, CAST(min(m) AS BIGINT) AS component FROM c GROUP BY id")
def cluster_components(spark, sf_dir):
    from quillon.operators.graph import connected_components
    from quillon.scratch import Scratch

    c = table(spark, sf_dir, "customer")
    edges = c.select(F.col("c_nationkey").cast("long").alias("a"), (1000 + F.col("c_custkey") % 7 * 100 + F.floor(F.col("c_nationkey") / 6)).cast("long").alias("b"))
    return connected_components(edges, Scratch(spark, "components"))


@query("SELECT o_orderkey AS e, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS cluster FROM orders")
def entity_cluster_groups(spark, sf_dir):
    """Entities joined by shared records; one cluster is a giant here, so the groups by priority take its place."""
    pairs, t = _both(spark, sf_dir)
    first = t.groupBy("country").agg(F.min("e").alias("cluster"))
    return E.entity_clusters(pairs, t.join(first, "country").select("e", "cluster"))[0]


@query()
def bootstrap_ci(spark, sf_dir):
    """Paired difference of two decoders with its interval; the draws are hashes."""
    pairs, t = _both(spark, sf_dir)
    a, b = (D.outcomes(D.decode(pairs, **v), pairs, t).select("e", "f") for v in ({}, {"t_single": 0.8}))
    customers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("e"), F.col("o_custkey").alias("cluster"))
    return E.bootstrap(a, b, customers)


def _stack_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = p.select(F.col("p_partkey").alias("id"), (2 + F.col("p_partkey") % 2).cast("int").alias("src"), F.lower("p_name").alias("core"), F.lower("p_type").alias("adf"), F.col("p_size").cast("string").alias("hmain"))
    return C.stack_features(scored(spark, sf_dir), parts)


@query()
def stacked_rescore(spark, sf_dir):
    """Out-of-fold scores of all stacking columns by a logistic model."""
    rows = _stack_rows(spark, sf_dir)
    return M.out_of_fold(rows.select("e", "src", "r", "y", *C.STACK), C.STACK, name="p_new").select("e", "src", "r", "y", F.col("p_new").alias("p"))


@query()
def oof_gbt_score(spark, sf_dir):
    """The views of a pair's rivals by boosted trees."""
    pairs = C.views(scored(spark, sf_dir)).withColumnRenamed("p", "p1")
    features = ["p1", "p_gap", "p_rival_gap", "n_cand"]
    return M.out_of_fold(pairs.select("e", "src", "r", "y", *features), features, kind="gbt").select("e", "src", "r", "y", "p")


@query()
def isotonic_calibrate(spark, sf_dir):
    """Cross-group isotonic calibration."""
    pairs, t = _both(spark, sf_dir)
    return M.isotonic(pairs.join(t.select("e", "country"), "e"), "country").select("e", "src", "r", "p", "p_cal")


@query()
def leave_group_out(spark, sf_dir):
    """Each order priority scored and decoded by what the others taught."""
    pairs, t = _both(spark, sf_dir)
    x = C.views(pairs).withColumnRenamed("p", "p1").join(t.select("e", "country"), "e")
    return M.leave_group_out(x.select("e", "src", "r", "y", "country", "p1", "p_gap", "n_cand"), ["p1", "p_gap", "n_cand"], t)
