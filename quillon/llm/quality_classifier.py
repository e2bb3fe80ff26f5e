"""Quality classifier: importance resampling by hashed n-gram models, sampled by Gumbel top-k.

After Xie et al. (2023): every text is a bag of n-grams hashed to buckets; one
multinomial model is estimated on target texts (those labelled good) and one on
all raw texts.  A text's log weight is the log ratio of its two likelihoods,
and the k texts with the largest ``log weight + Gumbel noise`` are kept, which
samples k without replacement in proportion to the weights.  The noise is a
hash of the id, so reruns agree.

The n-grams are single tokens, pairs of adjacent tokens (a token is a run of
letters and digits or a run of other signs) and echoes: a pair that came before
at most ``lags`` tokens earlier, by its distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K
from quillon.llm.order_statistics import kth_largest
from quillon.llm.quality_rules import labelled_sample
from quillon.scratch import Scratch


@dataclass(frozen=True)
class ResampleConfig:
    """buckets: of the hashed n-grams; sample: labelled rows used at most; spare: share of labelled good
    texts that the weight above which k is counted may lose; prior: count added to every bucket of both models, so that rare n-grams of few labelled texts say little."""

    buckets: int = 1 << 15
    lags: int = 24
    sample: int = 20_000
    prior: float = 30.0
    spare: float = 0.002
    seed: int = 5


def _features(batch: pa.Array, cfg: ResampleConfig) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and the text it is of."""
    words = K.Words(*K.buffers(batch), table=K.CLASSES)
    h, doc = words.hashes(), words.documents()
    plain = cfg.buckets - cfg.lags
    buckets, owner = [(h % np.uint64(plain)).astype(np.int32)], [doc]
    if len(h) > 1:
        at = np.flatnonzero(doc[1:] == doc[:-1])
        pair = K.windows(h, 2)
        buckets.append((pair[at] % np.uint64(plain)).astype(np.int32))
        owner.append(doc[at])
        where = doc[:-1].copy()
        where[doc[1:] != doc[:-1]] = -1
        free = where >= 0
        for lag in range(1, min(cfg.lags, len(pair) - 1) + 1):
            echo = np.flatnonzero((pair[lag:] == pair[:-lag]) & (where[lag:] == where[:-lag]) & free[lag:]) + lag
            free[echo] = False  # the nearest echo only
            buckets.append(np.full(len(echo), plain + lag - 1, np.int32))
            owner.append(where[echo])
    return np.concatenate(buckets), np.concatenate(owner)


def fit(documents: DataFrame, labels: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> tuple[np.ndarray, float]:
    """Log ratio of every bucket, and the log weight above which a text is counted towards k.

    The raw counts are over all documents.  The target counts come from two thirds
    of at most ``cfg.sample`` labelled rows, the cut from the others.  Only the buckets' sums (two numbers
    a bucket) and the labelled rows' weights come to the driver.  Without good
    labelled rows all ratios are 0 and every text counts.
    """
    spark = documents.sparkSession
    quality = {r.doc_id: r.quality for r in labelled_sample(labels, cfg.sample).collect()}
    held = dict(list(quality.items())[::3])  # they come in the order of an id hash
    good = np.sort(np.array([i for i, q in quality.items() if q == 1 and i not in held], np.int64))
    shared = spark.sparkContext.broadcast(good)
    K.small_batches(spark)

    def count(batches):
        sums = np.zeros((2, cfg.buckets), np.int64)
        for whole in batches:
            for batch in K.chunks(whole):
                bucket, owner = _features(batch.column(1), cfg)
                target = np.isin(batch.column(0).fill_null(-1).to_numpy(), shared.value)
                sums[0] += np.bincount(bucket, minlength=cfg.buckets)
                sums[1] += np.bincount(bucket[target[owner]], minlength=cfg.buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(K.tidy(count), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    if not target.sum():
        return np.zeros(cfg.buckets, np.float32), -np.inf
    # both are brought to the target's size, so that the prior weighs alike: what few labelled texts lack is then hardly evidence
    smooth = lambda c: np.log((c + cfg.prior) / (c.sum() + cfg.prior * len(c)))
    ratio = (smooth(target) - smooth(raw * (target.sum() / raw.sum()))).astype(np.float32)
    chosen = spark.createDataFrame([(int(i), int(q)) for i, q in held.items()], "doc_id long, quality int")
    near = rows.join(F.broadcast(chosen), "doc_id")  # at most cfg.sample ids
    one = log_weights(near.select("doc_id", "text"), ratio, cfg).groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"))  # one row an id
    seen = one.join(F.broadcast(chosen), "doc_id").select("log_weight", "quality").toArrow()
    return ratio, _cut(seen.column("log_weight").to_numpy(), seen.column("quality").to_numpy() == 1, cfg)


def _cut(weight: np.ndarray, is_good: np.ndarray, cfg: ResampleConfig) -> float:
    """The weight with the best balanced accuracy among those that lose at most ``spare`` of the good rows."""
    if not is_good.any() or is_good.all():
        return -np.inf
    good, bad = np.sort(weight[is_good]), np.sort(weight[~is_good])
    cuts = np.unique(weight)
    lost, caught = np.searchsorted(good, cuts) / len(good), np.searchsorted(bad, cuts) / len(bad)
    worth = np.where(lost <= cfg.spare, caught - lost, -1)
    best = int(np.argmax(worth))
    return float((cuts[best] + cuts[best - 1]) / 2) if best else -np.inf


def log_weights(rows: DataFrame, ratio: np.ndarray, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """``(doc_id, mark, log_weight)`` of every row of (doc_id, text); mark is a hash of the text, and a text without tokens has weight 0."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)
    ddl = "doc_id long, mark long, log_weight double"
    schema = K.arrow_schema(ddl)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, owner = _features(batch.column(1), cfg)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.bincount(owner, shared.value[bucket], minlength=batch.num_rows))], schema=schema)

    return K.map_text(rows.select("doc_id", "text", F.xxhash64("text").alias("mark")), work, ddl)


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """``(doc_id, mark, log_weight, key, kept)`` of every row of ``documents``.

    k: how many texts the sample takes; by default as many as have a log weight
    above the cut found on the labelled rows.  Rows of equal key stand or fall
    together, so copies of an id with equal text may make the sample larger by
    their number.  A null text counts as empty, a null id as one id.  No rows give
    no rows; labels that name no document, or none at all, keep every row.
    """
    ratio, cut = fit(documents, labels, cfg)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    uniform = (F.pmod(F.xxhash64(F.lit(cfg.seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = log_weights(rows, ratio, cfg).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = Scratch(documents.sparkSession, "resample").keep(scored, "scored")
    if k is None:
        k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_largest(scored, "key", k)
    return scored.withColumn("kept", F.col("key") >= F.lit(least))
