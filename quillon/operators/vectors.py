"""Nearest vectors by cosine: exact in blocks, or by signed random projections."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType


def cosine_topk(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, key: str = "vec_id", vector: str = "embedding", block: int = 4096, same: bool = True) -> DataFrame:
    """``(q, v, cosine, place)``: the k best of ``base`` for each query, by exact products: the yardstick of ``projection_topk``.

    Base rows are dealt to blocks by a hash and queries too; a pair of blocks is one
    matrix product, and each keeps its k best a query, so what is shuffled beyond the
    blocks is k rows a query and block.  Equal cosines go by id.  same: queries and base are
    rows of one table, where a row is not its own neighbour; of two tables equal ids are different things.
    """
    n = base.count()
    m = queries.count()
    nb, nq = max(1, -(-n // block)), max(1, -(-m // block))
    cols = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")]
    place = lambda size, name: F.pmod(F.xxhash64("id"), F.lit(size)).alias(name)
    each = lambda size, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name)
    b = base.select(*cols).select("id", "x", place(nb, "b"), F.lit(0).alias("side")).select("*", each(nq, "q"))
    q = queries.select(*cols).select("id", "x", place(nq, "q"), F.lit(1).alias("side")).select("*", each(nb, "b")).select("id", "x", "b", "side", "q")
    rows = b.unionByName(q).where("x is not null")

    within = _products(k, least, same)
    got = rows.groupBy("b", "q").applyInArrow(within, "q long, v long, cosine double")
    order = W.partitionBy("q").orderBy(F.desc("cosine"), "v")
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix."""
    lists = column.combine_chunks()
    wide = np.unique(lists.value_lengths().to_numpy())
    if len(wide) != 1:
        raise ValueError(f"vectors of {len(wide)} lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), wide[0])


def _products(k: int, least: float, same: bool, digits: int = 12):
    """The k best right rows (side 0) of each left row (side 1) of a unit's table (id, side, x).

    Only products that reach ``least`` are put in order, and if those are many, of each left row only what its k-th best leaves.
    """
    floor, far = max(least, -1.0), 10.0 ** (1 - digits)

    def within(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        x = _matrix(table.column("x"))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        right = right[np.argsort(ids[right])]
        out = {"q": [], "v": [], "cosine": []}
        if len(left) and len(right):
            sims = x[left] @ x[right].T
            if same:
                sims[ids[left][:, None] == ids[right][None, :]] = -2
            hit = sims >= floor - far
            if len(right) > k and np.count_nonzero(hit) > 16 * k * len(left):
                hit &= sims >= np.partition(sims, len(right) - k, axis=1)[:, len(right) - k, None] - far
            row, col = np.nonzero(hit)
            got = np.round(sims[row, col], digits)
            order = np.lexsort((col, -got, row))
            order = order[got[order] >= floor]
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            out = {"q": ids[left][row[order]], "v": ids[right][col[order]], "cosine": got[order]}
        return pa.table({"q": pa.array(out["q"], pa.int64()), "v": pa.array(out["v"], pa.int64()), "cosine": pa.array(out["cosine"], pa.float64())})

    return within


@dataclass(frozen=True)
class ProjectionConfig:
    """target: base rows of a bucket aimed at; most_bits: of a code; miss: chance that a pair at the least cosine asked for (``aim`` at least) is
    met in no table, 0: none may be missed, so one bucket has all rows; tables: independent codes, at most; block: rows of one side of a unit of work."""

    target: int = 256
    miss: float = 0.01
    aim: float = 0.3
    tables: int = 48
    most_bits: int = 24
    block: int = 2048
    seed: int = 13


def _shape(rows: int, least: float, cfg: ProjectionConfig) -> tuple[int, int]:
    """Bits of a code and how many tables: the bits that bring a bucket to its target, or as many fewer as keep the tables enough.

    One bucket has all rows, and the search is exact, where the buckets that a query looks in would hold over half as many.
    """
    if cfg.miss <= 0:
        return 0, 1
    turn = math.acos(min(1.0, max(least, cfg.aim))) / math.pi  # chance that a pair differs in one sign
    for bits in range(max(0, min(cfg.most_bits, math.ceil(math.log2(max(1.0, rows / cfg.target))))), -1, -1):
        met = (1 - turn) ** bits + bits * turn * (1 - turn) ** max(0, bits - 1)
        tables = 1 if met >= 1 - cfg.miss else math.ceil(math.log(cfg.miss) / math.log1p(-met))
        if tables <= cfg.tables:
            return (bits, tables) if 2 * tables * (bits + 1) <= 1 << bits else (0, 1)
    return 0, 1


def projection_topk(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, group: str | None = None, key: str = "vec_id", vector: str = "embedding", cfg: ProjectionConfig = ProjectionConfig(), same: bool = True, digits: int = 12) -> DataFrame:
    """``(q, v, cosine, place)`` as ``cosine_topk``, from an index of signed random projections (Charikar, 2002).

    Every base row is put in one bucket of each table: the signs of its products with
    the table's random directions, of which there are as many as bring a bucket of the
    largest group to about ``target`` rows, unless too many tables would be needed to meet
    the pairs asked for: then buckets are larger, and where they would spare no work there is one bucket, in which
    nothing is missed.  A query looks in its own bucket and in those that differ in one sign.  What it meets is ranked by exact cosines.  group: a column that both
    sides have; neighbours are of the query's own.  Buckets larger than a block are cut into
    several units, each of which gives its k best a query, so a bucket of any size is whole and
    no task holds it.  Rows without a vector are left out.  digits: cosines are rounded to so many before they are compared.
    """
    by = [group] if group else []
    most = base.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = _shape(most, least, cfg)
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    size = queries.select(F.max(F.size(vector))).first()[0] or 1
    planes = rng.normal(size=(max(bits, 1), tables, size))

    @F.pandas_udf(ArrayType(LongType()))
    def codes(vectors: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, size))
        out = np.zeros((len(x), tables), np.int64)
        for b in range(bits):
            out |= (x @ planes[b].T > 0).astype(np.int64) << b
        return pd.Series(list(out))

    g = F.col(group).cast("string") if group else F.lit("")
    cols = [g.alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")]
    place = lambda df: df.select(*cols).where("x is not null").withColumn("code", codes("x") if bits else F.array(F.lit(0).cast("long"))).select("g", "id", "x", F.posexplode("code").alias("t", "code"))
    near = F.concat(F.array(F.col("code")), F.array(*[F.col("code").bitwiseXOR(F.lit(1 << b)) for b in range(bits)]).cast("array<bigint>"))
    held = place(base).select("g", "t", "code", "id", "x")
    asked = place(queries).select("g", "t", F.explode(near).alias("code"), "id", "x")
    sizes = held.groupBy("g", "t", "code").agg(F.ceil(F.count("*") / cfg.block).alias("blocks"))
    asks = asked.groupBy("g", "t", "code").agg(F.ceil(F.count("*") / cfg.block).alias("turns"))
    units = sizes.join(asks, ["g", "t", "code"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = held.join(units, ["g", "t", "code"]).select("g", "t", "code", F.pmod(F.xxhash64("id"), "blocks").alias("b"), each("turns").alias("a"), F.lit(0).alias("side"), "id", "x")
    left = asked.join(units, ["g", "t", "code"]).select("g", "t", "code", each("blocks").alias("b"), F.pmod(F.xxhash64("id"), "turns").alias("a"), F.lit(1).alias("side"), "id", "x")
    met = right.union(left).groupBy("g", "t", "code", "b", "a").applyInArrow(_products(k, least, same, digits), "q long, v long, cosine double")
    order = W.partitionBy("q").orderBy(F.desc("cosine"), "v")
    return met.groupBy("q", "v").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(pairs, found, recall)``: the share of exact neighbours (q, v) that an index found."""
    hit = exact.select("q", "v").join(found.select("q", "v", F.lit(1).alias("hit")), ["q", "v"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"), F.try_divide(F.count("hit").cast("double"), F.count("*").cast("double")).alias("recall"))


def retrieve(records: DataFrame, k: int = 5, least: float = 0.5, cfg: ProjectionConfig = ProjectionConfig()) -> DataFrame:
    """``(country, e, src, r, cosine)``: for every record with a name and no number, the nearest entities of its country by name vectors.

    records: (id, src, country, core, nums, embedding).  Sources keep their ids apart, so record ids need not differ between them.
    """
    base = records.where("src = 1 and core <> ''").select("country", F.col("id").alias("vec_id"), "embedding")
    made = []
    for src in (2, 3):
        asked = records.where((F.col("src") == src) & (F.col("nums") == "") & (F.col("core") != "")).select("country", F.col("id").alias("vec_id"), "embedding")
        found = projection_topk(asked, base, k, least, "country", cfg=cfg, same=False)
        made.append(found.join(asked.select("country", F.col("vec_id").alias("q")), "q").select("country", F.col("v").alias("e"), F.lit(src).alias("src"), F.col("q").alias("r"), "cosine"))
    return made[0].unionByName(made[1])


def hashed_vector(text: str, size: int = 64, grams: int = 3) -> np.ndarray:
    """Unit vector of a string's hashed character n-grams with signs; zeros for an empty string."""
    padded = f" {text.lower()} "
    h = np.array([zlib.crc32(padded[i : i + grams].encode()) for i in range(max(1, len(padded) - grams + 1))], np.int64)
    out = np.bincount(h % size, np.where(h >> 20 & 1, 1.0, -1.0), size) if text else np.zeros(size)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def hashed_vectors(df: DataFrame, text: str, size: int = 64, grams: int = 3) -> DataFrame:
    """Adds ``embedding`` by ``hashed_vector``, the stand-in for a text encoder; a null text counts as empty."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashed_vector(x or "", size, grams))

    return df.withColumn("embedding", encode(F.coalesce(F.col(text), F.lit(""))))
