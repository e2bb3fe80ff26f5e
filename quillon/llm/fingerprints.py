"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint holds the k smallest 48-bit hashes of a text's distinct five-word
shingles (A-Z lowered).  Two fingerprints of parts merge into that of their
union; two of any sets estimate resemblance, containment and distinct counts
(Broder, 1997; Cohen and Kaplan, 2007).  As a string it is base64 of the sorted
hashes, 6 bytes each, so equal sets have equal strings; no shingles give "".
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillon.llm import kernels as K

_SPACE = float(1 << 48)
#: Stands for a null id in comparisons: such rows come first.
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SketchConfig:
    words: int = 5
    k: int = 128


def sketches(column: pa.Array, cfg: SketchConfig = SketchConfig()) -> list[np.ndarray]:
    """The sorted k smallest distinct hashes of every text; null counts as empty."""
    h, offs = K.shingle_sets(K.Words(*K.buffers(column)), cfg.words)
    h >>= np.uint64(16)  # sorted by all 64 bits, so sorted still
    out = []
    for a, b in zip(offs[:-1], offs[1:]):
        low = h[a : min(b, a + cfg.k)]
        if len(low) > 1 and (low[1:] == low[:-1]).any():
            low = np.unique(h[a:b])[: cfg.k]
        out.append(low.copy())
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    part = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, 2:] = part
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(*parts: np.ndarray, k: int = 128) -> np.ndarray:
    """The sketch of the union of the sets behind some sketches."""
    return np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))[:k]


def distinct(sketch: np.ndarray, k: int = 128) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / _SPACE)


def resemblance(x: np.ndarray, y: np.ndarray, k: int = 128) -> float:
    """Estimated size of the intersection against the union; exact if the union has at most k; 1 for two empty sets."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = ~twice
    rank = np.cumsum(first)
    n = min(int(rank[-1]), k)
    return float((twice & (rank[1:] <= n)).sum()) / n


def containment(x: np.ndarray, y: np.ndarray, k: int = 128) -> float:
    """Estimated share of the first set that the second holds; 1 if the first is empty."""
    if not len(x):
        return 1.0
    j = resemblance(x, y, k)
    union = distinct(merge(x, y, k=k), k)
    return min(1.0, j * union / distinct(x, k))


def fingerprint(df: DataFrame, cfg: SketchConfig = SketchConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, fingerprint)`` of every row; n_shingles is the sketch's estimate.

    A null text counts as empty: 0 and "".  Repeated rows and null ids come back one
    by one; no rows give no rows; other columns are not read.
    """
    ddl = "doc_id long, n_shingles double, fingerprint string"
    schema = K.arrow_schema(ddl)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = sketches(batch.column(1), cfg)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([distinct(x, cfg.k) for x in made], pa.float64()), pa.array([to_text(x) for x in made], pa.string())], schema=schema)

    return K.map_text(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, ddl)


@F.pandas_udf(T.StringType())
def _merged(prints: pd.Series) -> str:
    return to_text(merge(*[from_text(x or "") for x in prints]))


@F.pandas_udf(T.LongType())
def _total(n: pd.Series) -> int:
    return int(n.sum())


def merge_by(prints: DataFrame, *keys: str, fingerprint: str = "fingerprint") -> DataFrame:
    """``(keys..., n_parts, n_shingles, fingerprint)``: the sketch of the union of each key's parts.

    Parts are merged within each task first, so a key of any number of parts comes
    to one task as one sketch a task.  Null keys are one key; a null sketch is an empty
    one; repeated parts change nothing but ``n_parts``; no rows give no rows.
    """
    parts = prints.select(*keys, F.col(fingerprint).alias("fingerprint"), F.lit(1).cast("long").alias("n_parts"), F.spark_partition_id().alias("__task"))
    both = (_merged("fingerprint").alias("fingerprint"), _total("n_parts").alias("n_parts"))
    whole = parts.groupBy(*keys, "__task").agg(*both).groupBy(*keys).agg(*both)
    return whole.select(*keys, "n_parts", compare("fingerprint", "fingerprint")["distinct_x"].alias("n_shingles"), "fingerprint")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("resemblance", "containment", "distinct_x", "distinct_y")]))
def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Resemblance of two columns of fingerprints, how much of the first the second contains, and both distinct counts; null counts as empty."""
    pairs = [(from_text(a or ""), from_text(b or "")) for a, b in zip(x, y)]
    rows = [(resemblance(a, b), containment(a, b), distinct(a), distinct(b)) for a, b in pairs]
    return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_x", "distinct_y"])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_study(df: DataFrame, cfg: SketchConfig = SketchConfig(), ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: EDITED.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document by ascending id; the first follows the
    last.  Texts are dealt once, by ranges of ids; the first row of each range is
    also sent to the range before it, so no task needs another's rows.  The
    driver holds two ids for each range.

    Null ids come first; rows of equal ids are ordered by the hash of their text.
    A null text is empty.  A single row is its own next.  No rows give no rows.
    """
    spark: SparkSession = df.sparkSession
    K.small_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = ranges or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(sorted({int(v) for v in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}), np.int64)
    whole_ids = lambda column: column.fill_null(_NO_ID).to_numpy()

    def heads(batches):
        """The least id of each range in a task."""
        least = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
        for batch in batches:
            ids = whole_ids(batch.column(0))
            np.minimum.at(least, np.searchsorted(cuts, ids, "right"), ids)
        at = np.flatnonzero(least < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at])], ["part", "id"])

    found = rows.select("doc_id").mapInArrow(K.tidy(heads), "part long, id long").groupBy("part").agg(F.min("id").alias("id")).orderBy("part").collect()
    first = np.array([r.id for r in found], np.int64)  # ascending, as the ranges are
    before = np.array([found[i - 1].part for i in range(len(found))], np.int64)

    def deal(batches):
        """Each row to its range, and the first of a range also to the end of the range before."""
        for whole in batches:
            for batch in K.chunks(whole):
                ids = whole_ids(batch.column(0))
                at = np.minimum(np.searchsorted(first, ids), max(len(first) - 1, 0))
                again = np.flatnonzero(first[at] == ids)
                rows_ = np.concatenate([np.arange(len(ids)), again])
                part = np.concatenate([np.searchsorted(cuts, ids, "right"), before[at[again]]])
                after = np.repeat([0, 1], [len(ids), len(again)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(after), batch.column(0).take(rows_), batch.column(1).take(rows_)], ["part", "after", "doc_id", "text"])

    dealt = rows.mapInArrow(K.tidy(deal), "part long, after int, doc_id long, text string").withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "after", F.asc_nulls_first("doc_id"), "h").select("part", "after", "doc_id", "text")
    schema = K.arrow_schema(EDITED)

    def study(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t if (half := len(t) // 2) == 0 else t[: len(t) - half] + f[:half] for t, f in zip(texts, following)]
        own, other, after = (sketches(pa.array(x, pa.large_string()), cfg) for x in (texts, edited, following))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([to_text(x) for x in own], pa.string()),
                pa.array([to_text(x) for x in other], pa.string()),
                pa.array([resemblance(x, y, cfg.k) for x, y in zip(own, other)]),
                pa.array([resemblance(x, y, cfg.k) for x, y in zip(own, after)]),
            ],
            schema=schema,
        )

    def run(batches):
        waiting, open_part = None, None  # the row whose next is still to come; the range that has got its next
        ids, texts, following, size = [], [], [], 0
        for whole in batches:
            for batch in K.chunks(whole, most=K.CHUNK_BYTES // 2):
                for part, after, i, t in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if after and (waiting is None or waiting[0] != part):
                        continue  # rows of equal ids at the head of the next range: the first is enough
                    if waiting is not None and waiting[0] == part:
                        ids.append(waiting[1])
                        texts.append(waiting[2])
                        following.append(t)
                        size += len(waiting[2])
                    waiting = None if after else (part, i, t)
                    if size >= K.CHUNK_BYTES // 2:
                        yield study(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
        if ids:
            yield study(ids, texts, following)

    return dealt.mapInArrow(K.tidy(run), EDITED)
