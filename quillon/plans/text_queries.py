"""Queries of normalization, string scores, vectors and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import normalize as N, rules
from quillon.functions.fuzzy import scorer
from quillon.operators import dictionary, vectors
from quillon.scratch import Scratch
from quillon.plans.registry import query, table


def _name_pairs(spark, sf_dir):
    """Distinct part names of one brand, each with the next."""
    from pyspark.sql import Window as W

    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    return names.withColumn("other", F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_name"))).where("other is not null")


_NAMES = "n AS (SELECT p_brand, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_name) AS other FROM (SELECT DISTINCT p_brand, p_name FROM part))"


@query(f"WITH {_NAMES} SELECT p_brand, p_name, other, CAST(levenshtein(p_name, other) AS INT) AS d FROM n WHERE other IS NOT NULL")
def string_levenshtein(spark, sf_dir):
    return _name_pairs(spark, sf_dir).withColumn("d", F.levenshtein("p_name", "other"))


@query(f"WITH {_NAMES} SELECT p_brand, p_name, other, round(jaro_winkler_similarity(p_name, other), 6) AS s FROM n WHERE other IS NOT NULL")
def string_jaro_winkler(spark, sf_dir):
    return _name_pairs(spark, sf_dir).withColumn("s", F.round(scorer("jaro_winkler")(F.col("p_name"), F.col("other")), 6))


@query()
def string_scores(spark, sf_dir):
    """Indel, token sort, token set and partial ratios."""
    pairs = _name_pairs(spark, sf_dir)
    return pairs.withColumns({s: scorer(s)(F.col("p_name"), F.col("other")) for s in ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")})


@query(r"""WITH f AS (SELECT doc_id, text, strip_accents(lower(text)) AS s FROM documents) SELECT doc_id, array_to_string(regexp_extract_all(s, '[a-z]+'), ' ') AS folded FROM f""")
def fold_text(spark, sf_dir):
    s = N.fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), " ").alias("folded"))


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _lookup(table, token: str) -> str:
    """SQL for a token's entry in a fixed table, NULL without one."""
    return f"({_list(table.values())})[nullif(list_position({_list(table)}, {token}), 0)]"


def _replaced(sql: str, pattern: str, by: str) -> str:
    return f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"


_WEB = r"\bwww\.|\.(?:" + "|".join(rules.WEB_TLDS) + r")\b"
_GLUED = _replaced(_replaced("s", _WEB, " "), r"\bm\s*/\s*s\b", " ")
for _pattern, _form in rules.LEGAL_PATTERNS:
    _GLUED = _replaced(_GLUED, _pattern, _form)
_LEET = "^(?:[013458][a-z]{2,}|[a-z]{2,}[013458]|[a-z]+[013458][a-z]+)$"
_NAME_SQL = rf"""WITH a AS (SELECT doc_id, {_replaced(_replaced("strip_accents(lower(split_part(text, chr(10), 1)))", r"\|.*$", " "), r"\[[^\]]*\]|\(\s*id\s*:?\s*\d+\s*\)", " ")} AS s FROM documents),
b AS (SELECT doc_id, CAST(regexp_matches(s, '{_WEB}') AS TINYINT) AS web, string_split({_replaced(f"replace({_GLUED}, '&', ' and ')", "[^a-z0-9]+", " ")}, ' ') AS w FROM a),
c AS (SELECT doc_id, web, list_transform(list_filter(w, lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]{{4,}}$')), lambda t: CASE WHEN regexp_matches(t, '{_LEET}') AND NOT regexp_matches(t, '^[0-9]+(?:st|nd|rd|th)$') THEN translate(t, '{rules.LEET[0]}', '{rules.LEET[1]}') ELSE t END) AS w FROM b),
d AS (SELECT doc_id, web, list_filter(w, lambda t, i: i = 1 OR t <> w[i - 1]) AS t FROM c),
e AS (SELECT *, list_filter(t, lambda x: NOT list_contains({_list(rules.NAME_NOISE)}, x)) AS quiet FROM d), f AS (SELECT *, list_filter(quiet, lambda x: NOT list_contains({_list(rules.LEGAL)}, x)) AS named FROM e),
g AS (SELECT *, CASE WHEN len(named) > 0 THEN named WHEN len(quiet) > 0 THEN quiet ELSE t END AS c FROM f)
SELECT doc_id, array_to_string(t, ' ') AS nm, array_to_string(c, ' ') AS core, array_to_string(list_sort(list_distinct(list_filter(list_transform(t, lambda x: {_lookup(rules.LEGAL, "x")}), lambda x: x IS NOT NULL))), ' ') AS legal, array_to_string(c, '') AS cc, CAST(0 AS TINYINT) AS script, web FROM g"""


@query(_NAME_SQL)
def normalize_names(spark, sf_dir):
    """Names from each document's first line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("raw"))
    return N.with_name(docs, "raw").select("doc_id", "nm", "core", "legal", "cc", "script", "web")


@query(r"""WITH u AS (SELECT page_id, lower(url) AS s FROM pages) SELECT page_id, CAST(regexp_matches(s, '\bwww\.|\.(?:com|in|net|org|co|fr|biz|info|us)\b') AS TINYINT) AS web FROM u""")
def web_names(spark, sf_dir):
    return N.with_name(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "web")


_PLAIN_STATES = {k: v for k, v in rules.STATES.items() if " " not in k}
_ADDRESS = _replaced(r"strip_accents(lower(regexp_replace(text, '^[^\n]*\n?', '')))", r"\bn\s*[°º]", " ")
for _phrase in sorted((k for k in rules.STATES if " " in k), key=len, reverse=True):
    _ADDRESS = _replaced(_ADDRESS, rf"\b{_phrase}\b", rules.STATES[_phrase])
_SHORT = f"coalesce({_lookup(rules.ADDR_ABBR, 't')}, t)"
_ADDRESS_SQL = rf"""WITH a AS (SELECT doc_id, regexp_extract_all({_ADDRESS}, '[a-z0-9]+(?:[/-][a-z0-9]+)*') AS w FROM documents),
b AS (SELECT doc_id, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN t ELSE {_SHORT} END) AS w FROM a),
c AS (SELECT doc_id, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN t ELSE coalesce({_lookup(_PLAIN_STATES, "t")}, t) END) AS w FROM b),
d AS (SELECT doc_id, list_filter(w, lambda t: regexp_matches(t, '[0-9]') OR NOT list_contains({_list(rules.ADDR_DROP)}, t)) AS w FROM c),
e AS (SELECT doc_id, w, list_transform(list_filter(w, lambda t: regexp_matches(t, '[0-9]')), lambda t: list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: CASE WHEN length(x) < 18 THEN regexp_replace(x, '^0+([0-9])', '\1') ELSE x END)) AS n FROM d),
f AS (SELECT *, coalesce(n[1], []) AS h, list_transform(coalesce(n[1], []), lambda x: length(x)) AS z FROM e)
SELECT doc_id, array_to_string(list_filter(w, lambda t: NOT regexp_matches(t, '[0-9]')), ' ') AS ad, array_to_string(w, ' ') AS adf, array_to_string(flatten(n), ' ') AS nums, array_to_string(h, '-') AS hn, coalesce(h[list_position(z, list_max(z))], '') AS hmain FROM f"""


@query(_ADDRESS_SQL)
def normalize_addresses(spark, sf_dir):
    """Addresses from all lines of a document but the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"^[^\n]*\n?", "").alias("raw"))
    return N.with_address(docs, "raw").select("doc_id", "ad", "adf", "nums", "hn", "hmain")


@query(r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN length(x) < 18 THEN regexp_replace(x, '^0+([0-9])', '\1') ELSE x END) AS l FROM documents)
SELECT doc_id, array_to_string(l, ' ') AS nums, CAST(len(l) AS INT) AS n FROM d""")
def parse_numbers(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), N.number)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("nums"), F.size(found).alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_extract(lower(p_brand), '[0-9]+'), '^0+([0-9])', '\1') AS num FROM part""")
def brand_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.number(F.regexp_extract(F.lower("p_brand"), "[0-9]+", 0)).alias("num"))


_HEADS = ", ".join(f"'{x}'" for x in rules.UNIT_WORDS)
_UNIT_SQL = rf"""WITH a AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+(?:-[a-z0-9]+)*') AS w FROM documents),
b AS (SELECT doc_id, w, list_filter(w, lambda t, i: (regexp_matches(t, '{rules.UNIT_NUMBER}') AND coalesce(CASE WHEN i > 2 AND w[i - 1] = 'no' THEN w[i - 2] WHEN i > 1 THEN w[i - 1] END, '') IN ({_HEADS})) OR regexp_matches(t, '{rules.DASHED_NUMBER}')) AS u,
 coalesce(list_position(list_transform(w, lambda t: regexp_matches(t, '^[0-9]+[a-z]?$')), true), 0) AS h FROM a),
c AS (SELECT doc_id, list_distinct(list_transform(u, lambda t: regexp_replace(replace(t, '-', ''), '^([a-z]*)0+([0-9])', '\1\2'))) AS u, CASE WHEN h > 0 THEN regexp_extract(w[h], '[a-z]?$') ELSE '' END AS l, CASE WHEN h > 0 THEN w[h + 1] END AS f FROM b)
SELECT doc_id, array_to_string(list_sort(u), ' ') AS units, coalesce(nullif(l, ''), CASE WHEN regexp_matches(f, '^[a-d]$') THEN f END, CASE f {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SUFFIXES.items())} END, '') AS hsuf FROM c"""


@query(_UNIT_SQL)
def unit_suffix_flags(spark, sf_dir):
    docs = N.with_units(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.array_join(F.array_sort("units"), " ").alias("units"), "hsuf")


_COS = "round(list_inner_product(a.x, b.x) / nullif(sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)), 0), 6)"


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT a.vec_id AS q, b.vec_id AS v, {_COS} AS cosine FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT q, v, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS k FROM c) WHERE k <= 5 AND cosine >= 0")
def cosine_topk(spark, sf_dir):
    """The five nearest of all vectors for every id divisible by 50: a stated query set against all rows."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.cosine_topk(v.where(F.col("vec_id") % 50 == 0), v, 5, 0.0).select("q", "v", F.round("cosine", 6).alias("cosine"))


_TURNS = "p AS (SELECT string_split_regex(trim(lower(u.text)), '\\s+') AS l, string_split_regex(trim(lower(a.text)), '\\s+') AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE trim(u.text) <> '' AND trim(a.text) <> '')"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    words = F.split(F.trim(F.lower("text")), r"\s+")
    u, a = c.select("conv_id", "turn", words.alias("l")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), words.alias("r"))
    return u.join(a, ["conv_id", "turn"])


@query(f"WITH {_TURNS}, z AS (SELECT unnest(l) AS token, unnest(r) AS meaning FROM p WHERE len(l) = len(r)), c AS (SELECT token, meaning, count(*) AS n FROM z GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY token) AS total, row_number() OVER (PARTITION BY token ORDER BY n DESC, meaning) AS k FROM c) SELECT token, meaning, n, CAST(total AS BIGINT) AS total FROM t WHERE k = 1 AND total >= 2 AND n >= 0.5 * total")
def dictionary_mine(spark, sf_dir):
    """Words at equal places of a turn and the next one of the same length."""
    return dictionary.mine_tokens(_turns(spark, sf_dir), F.col("l"), F.col("r"))


@query("WITH s AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS l FROM pages), c AS (SELECT segment, meaning, count(*) AS n FROM (SELECT unnest(l) AS segment, l FROM s), (SELECT 1) z, LATERAL (SELECT unnest(l) AS meaning) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY segment) AS total, row_number() OVER (PARTITION BY segment ORDER BY n DESC, meaning) AS k FROM c) SELECT segment, meaning, n, CAST(total AS BIGINT) AS total FROM t WHERE k = 1 AND total >= 3")
def segment_mine(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return dictionary.mine_segments(table(spark, sf_dir, "pages").select(parts.alias("l")), F.col("l"), F.col("l"))


@query()
def embedding_retrieval(spark, sf_dir):
    """Names as hashed n-gram vectors: the five nearest entities, of its own country, of every record without a number, from a cosine of 0.5, by the index."""
    from quillon.plans.universe import records

    rec = records(spark, sf_dir).select("id", "src", "country", "core", "nums").where("core <> ''")
    return vectors.retrieve(Scratch(spark, "retrieval").keep(vectors.hashed_vectors(rec, "core"), "vectors"))
