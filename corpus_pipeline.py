"""The training-data pipeline: quality filter, near-dedup, secrets, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of documents.  ``run`` writes each stage's result to the
shared folder and reads it again before the next, as a scheduler would between
jobs, so a lost executor never costs more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import bpe, minhash_dedup, mixing, quality_classifier, queries, secret_scan
from quillon.scratch import Scratch
from quillon.sources.tables import table

#: The stages rest on hashes and fitted models, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    Rows are judged by id and text, so rows that repeat an id stand or fall by their own
    texts and equal rows together; a null id is an id like any other, and a null, empty or
    blank text has weight 0.  Without labels every row stays.
    """
    verdicts = quality_classifier.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = verdicts.where("kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs.doc_id.eqNullSafe(wanted["__id"]) & (F.xxhash64(docs.text) == wanted["__mark"])
    return docs.join(wanted, same, "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, exact copies included: that of the smallest id, null last.

    Every row is compared under a number of its own, so null and repeated ids are
    rows like any other.  A row without words is a group of its own.
    """
    rows = Scratch(spark, "numbered").keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = minhash_dedup.near_duplicates(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"]
    wanted = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(first.alias("__row")).select("__row")
    return rows.join(wanted, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars follows.

    Each row's own text decides, so null and repeated ids are rows like any other; a
    null text stays null, with a null n_chars.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a text that is null or has no words is never taken.

    A null source is a source of its own; rows of null or repeated ids are documents
    like any other; rows equal in id and text take each other's place.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row, repeated ones too; a null text is empty."""
    return bpe.encode(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", filter_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source mix", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{i}")
    return docs
