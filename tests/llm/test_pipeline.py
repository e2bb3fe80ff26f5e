"""The pipeline's stages against their operators and brute force, on odd documents and on the smallest tables."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import __spark_entry__ as entry
from quillon.llm import quality_classifier, secret_scan


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = docs
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, seen, sf).cache()
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if i == 0:
            kept = {r.doc_id for r in out.collect()}
            good = [d for d, q in labels.items() if q == 1]
            bad = [d for d, q in labels.items() if q == 0]
            assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)
        if i == 1:
            assert 0 < out.count() < seen.count()
        if i == 2:
            assert out.count() == seen.count()
            assert not any(secret_scan.spans(r.text or "") for r in out.collect())
        if i == 3:
            n = collections.Counter(r.doc_id for r in out.collect())
            assert max(n.values()) == 2
        seen = out
    assert seen.count() == n.total() and min(r.n_tokens for r in seen.collect()) > 0


def test_odd_documents(spark, docs, plain, sf):
    """Every stage on the odd documents, held against its operator run in Python or on the stage's own input."""
    rows = lambda df: collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    good, near, clean, mixed, tokens = (stage for _, stage in P.STAGES)
    kept = good(spark, docs, sf)
    verdicts = {(r.doc_id, r.mark): r.kept for r in quality_classifier.resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    marked = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("mark")).collect()
    assert rows(kept) == collections.Counter((r.doc_id, r.text, r.source) for r in marked if verdicts[r.doc_id, r.mark])
    assert any(r.doc_id is None for r in kept.collect())

    one = near(spark, docs, sf)  # on all rows, null ids and repeated ones included
    assert rows(one) - rows(docs) == collections.Counter()
    texts = [r.text for r in one.collect()]
    assert len([t for t in texts if count(t)]) == len({t for t in texts if count(t)})
    assert sum(count(t) == 0 for t in texts) == sum(count(t) == 0 for _, t, _ in plain)
    assert {r.doc_id for r in one.collect()} >= {None, 302, 303, 305, 308}

    out = clean(spark, docs, sf)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(i for i, _, _ in plain)
    assert all((r.text is None) == (r.n_chars is None) and not secret_scan.spans(r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in out.collect())

    taken, before = mixed(spark, docs, sf).collect(), rows(docs)
    assert all(count(r.text) > 0 for r in taken) and sum(count(r.text) for r in taken) == pytest.approx(1.5 * sum(count(t) for _, t, _ in plain), rel=0.01)
    assert collections.Counter((r.doc_id, r.source) for r in taken) - collections.Counter({k: 2 * n for k, n in collections.Counter((i, s) for i, _, s in before.elements()).items()}) == collections.Counter()

    assert collections.Counter(r.doc_id for r in tokens(spark, docs, sf).collect()) == collections.Counter(i for i, _, _ in plain)
    seen = docs
    for _, stage in P.STAGES:
        seen = stage(spark, seen, sf).cache()
    assert seen.count() > 0 and any(r.doc_id is None for r in seen.collect())
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_quality_judges_rows_that_repeat_an_id_by_their_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdicts = quality_classifier.resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    bad, good = ([r.doc_id for r in verdicts if r.kept == want][:3] for want in (False, True))
    again = docs.where(F.col("doc_id").isin(bad + good)).withColumn("doc_id", F.lit(None).cast("long"))
    out = P.filter_quality(spark, docs.unionByName(again), sf)
    texts = {r.text for r in docs.where(F.col("doc_id").isin(good)).collect()}
    assert {r.text for r in out.where("doc_id is null").collect()} <= texts | {r.text for r in docs.where(F.col("doc_id").isin(bad)).collect()}
    assert out.columns == docs.columns


def test_dedup_keeps_one_row_of_each_group(spark, sf):
    long = lambda word, n=40: " ".join(f"{word}{i}" for i in range(n))
    rows = [
        (None, long("alone")),  # unique, without an id
        (None, long("bare")), (None, long("bare")),  # a group without ids
        (None, long("mixed")), (5, long("mixed")), (4, long("mixed") + " end"),  # the least id stays
        (7, long("twice")), (7, long("twice")),  # an id repeated with its text
        (8, long("north")), (8, long("south")), (9, long("north")), (10, long("south")),  # and with another
        (None, None), (11, ""),  # no words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, sf).collect())
    want = [(None, long("alone")), (None, long("bare")), (4, long("mixed") + " end"), (7, long("twice")), (8, long("north")), (8, long("south")), (None, None), (11, "")]
    assert got == collections.Counter(want)


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
