"""One query for each operator of this subpackage, over whole tables with production parameters.

Near-dedup, whose result its definition fixes, has a SQL twin.  The others rest on
hashes, fitted models or byte-level work that portable SQL has no words for; the
tests hold them against brute force.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.sources.tables import table


def tokenizer_path() -> str:
    """The word-level BPE file of the public tokenizers; any other path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality_rules import apply_rules, fit_rules

    documents = table(spark, sf_dir, "documents")
    made = apply_rules(documents, fit_rules(documents, table(spark, sf_dir, "labels")))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Two sets at 0.75 share one of the rarest n - ceil(0.75 n) + 1 of each; who shares one is compared in full, and links are followed to their ends.
OP2_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:])[1:greatest(len(w) - 4, 1)], lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])))) AS s FROM words),
classes AS (SELECT s, row_number() OVER () AS id, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, unnest(s) AS t FROM classes),
freq AS (SELECT t, count(*) AS f FROM items GROUP BY t),
ranked AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY f, t) AS k FROM items JOIN freq USING (t)),
rare AS (SELECT id, n, t FROM ranked WHERE k <= n - (3 * n + 3) // 4 + 1),
tried AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n + b.n AS n FROM rare a JOIN rare b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM tried JOIN items x ON x.id = a JOIN items y ON y.id = b AND y.t = x.t GROUP BY a, b, tried.n HAVING 100 * count(*) >= 75 * (tried.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS c FROM classes UNION SELECT reach.id, b FROM reach JOIN edges ON a = c),
smallest AS (SELECT reach.id, min(least) AS component_id FROM reach JOIN classes ON classes.id = c GROUP BY reach.id),
placed AS (SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN classes.id IS NULL THEN doc_id ELSE component_id END AS component_id FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN smallest ON smallest.id = classes.id)
SELECT *, coalesce(doc_id = component_id, FALSE) AS kept FROM placed"""


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality_classifier import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each path's findings; a span is kind:start:end."""
    from quillon.llm.secret_scan import BASE, findings_by_path, update_ledger

    found = findings_by_path(*update_ledger(table(spark, sf_dir, "documents")))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["until"])), ",")
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.fingerprints import edit_study

    return edit_study(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = (op1_quality_rules, op2_minhash_dedup, op3_source_mix, op4_bpe, op5_quality_classifier, op6_license_scan, op7_sharding, op8_secret_scan, op9_fingerprints, op10_lm_score)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": OP2_SQL}
