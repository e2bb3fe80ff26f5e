"""Histogram sort: documents dealt to shards of near equal bytes, in one exchange.

Rows are ordered by (hash of the text, id), so copies of a text stand together.
The cuts between shards are found by counting (Solomonik and Kale, 2010): a round sends a
few probe keys for each open cut to all partitions, each counts the exact rows and
bytes below every probe, and the interval that holds a cut is probed again until the
cut's bytes are within tolerance.  Probes, counts and cuts are a few for each shard,
whatever the number of rows.

A group of equal texts is cut only if near equal bytes need it: if both its ends are
farther from the cut's place than ``group`` of a shard's bytes and than two of its rows.

Within a shard rows stand by ranges of another hash, whose number follows the rows.
One aggregate counts the ranges, and each range's first slot travels with
its rows as a row of its own, so one exchange of the whole rows gives every slot.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.llm import kernels as K
from quillon.scratch import Scratch

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class ShardConfig:
    """tolerance: of a cut, against a shard's bytes; group: the same for keeping a group of equal texts whole; steps: probes stand
    off the guessed place by these parts of the interval, and ``even`` parts of it; range_rows, range_bytes: about so many rows, and bytes of text, are sorted by one task."""

    shards: int = 24
    tolerance: float = 0.001
    group: float = 0.02
    steps: tuple[int, ...] = (64, 1024)
    even: int = 8
    range_rows: int = 200_000
    range_bytes: int = 128 << 20
    max_rounds: int = 40


def _as_int(hash_: int, id_: int) -> int:
    return ((hash_ - _LOW) << 64) | (id_ - _LOW)


def _as_pair(key: int) -> tuple[int, int]:
    return (key >> 64) + _LOW, (key & ((1 << 64) - 1)) + _LOW


def _below(h: np.ndarray, ids: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """How many of the sorted probe keys are at or below each row's key."""
    at = np.searchsorted(ph, h, "left")
    to = np.searchsorted(ph, h, "right")
    for r in np.flatnonzero(to > at):
        at[r] += np.searchsorted(pi[at[r] : to[r]], ids[r], "right")
    return at


def _count(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int], list[tuple[int, int] | None]]:
    """Exact rows and bytes of each cell between sorted probes (one more than these), and the bounds of its keys.

    One small row a task and cell is shuffled.  A cell of several hashes is bounded
    by whole hashes, a cell of one by its ids.
    """
    pairs = [_as_pair(p) for p in probes]
    ph, pi = (np.array(x, np.int64) for x in zip(*pairs))

    def run(batches):
        n, size = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        low, high = np.full((2, len(ph) + 1), _HIGH, np.int64), np.full((2, len(ph) + 1), _LOW, np.int64)
        for b in batches:
            h, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = _below(h, ids, ph, pi)
            n += np.bincount(at, minlength=len(n))
            np.add.at(size, at, b.column(2).to_numpy())
            for row, value in enumerate((h, ids)):
                np.minimum.at(low[row], at, value)
                np.maximum.at(high[row], at, value)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, n[at], size[at], low[0][at], high[0][at], low[1][at], high[1][at])], ["at", "n", "size", "h0", "h1", "i0", "i1"])

    cells = keys.select("h", "doc_id", "size").mapInArrow(K.tidy(run), "at long, n long, size long, h0 long, h1 long, i0 long, i1 long")
    got = cells.groupBy("at").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), *[f(c).alias(c) for f, c in ((F.min, "h0"), (F.max, "h1"), (F.min, "i0"), (F.max, "i1"))]).collect()
    n, size, bounds = [0] * (len(ph) + 1), [0] * (len(ph) + 1), [None] * (len(ph) + 1)
    for r in got:
        n[r["at"]], size[r["at"]] = r["n"], r["size"]
        bounds[r["at"]] = (_as_int(r["h0"], r["i0"]), _as_int(r["h0"], r["i1"]) + 1) if r["h0"] == r["h1"] else (_as_int(r["h0"], _LOW), _as_int(r["h1"], _HIGH) + 1)
    return n, size, bounds


def find_cuts(keys: DataFrame, rows: int, size: int, targets: list[float], per: float, cfg: ShardConfig) -> list[tuple[int, int, int]]:
    """For each ascending target, a key with about so many bytes below it, and its exact (key, rows, bytes) below.

    rows, size: of all keys; per: bytes of a shard, which the tolerances are parts of.
    """
    span = [[(0, 0, 0), (1 << 128, rows, size)] for _ in targets]  # (key, rows, bytes) at both ends
    best: list[tuple[int, int, int] | None] = [None] * len(targets)
    split: set[int] = set()  # cuts that a group of equal texts was found at
    for _ in range(cfg.max_rounds):
        wanted: set[int] = set()
        for t, (low, high) in enumerate(span):
            if best[t] is not None:
                continue
            gap = high[0] - low[0]
            # hashes are spread evenly, so whole hashes are probed until one hash is left; then its ids
            unit = 1 << 64 if gap > 1 << 64 else 1
            guess = low[0] + int(gap * min(1.0, max(0.0, (targets[t] - low[2]) / max(1, high[2] - low[2]))))
            # around the place where even sizes would put the cut, and evenly in case they are uneven
            for key in (guess, *(guess + side * gap // part for part in cfg.steps for side in (-1, 1)), *(low[0] + gap * i // cfg.even for i in range(1, cfg.even))):
                k = -(-key // unit) * unit
                if low[0] < k < high[0]:
                    wanted.add(k)
        if not wanted:
            break
        probes = sorted(wanted)
        n, b, bounds = _count(keys, probes)
        below = [(0, 0)]
        for x, y in zip(n, b):
            below.append((below[-1][0] + x, below[-1][1] + y))
        sums = [y for _, y in below[1:-1]]  # bytes below each probe
        for t, (low, high) in enumerate(span):
            if best[t] is not None:
                continue
            c = bisect.bisect_right(sums, targets[t])  # the cell that holds the cut
            if c > 0:
                low = max(low, (probes[c - 1], *below[c]))
            if c < len(probes):
                high = min(high, (probes[c], *below[c + 1]))
            allowed = cfg.tolerance * per
            if bounds[c] is not None:  # no rows stand between the cell's ends and its keys' bounds
                low, high = (max(low[0], bounds[c][0]), *low[1:]), (min(high[0], bounds[c][1]), *high[1:])
                if low[0] >> 64 == (high[0] - 1) >> 64 and t not in split:  # one group of equal texts, all of it
                    allowed = max(allowed, cfg.group * per, 2 * (high[2] - low[2]) / max(1, high[1] - low[1]))
                    split.add(t)
            span[t] = [low, high]
            near = min((low, high), key=lambda x: abs(x[2] - targets[t]))
            if abs(near[2] - targets[t]) <= allowed or high[1] - low[1] <= 1 or high[0] - low[0] <= 1:
                best[t] = near
    return [b or min(s, key=lambda x: abs(x[2] - targets[t])) for t, (b, s) in enumerate(zip(best, span))]


SHARDED = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _nulls(columns: list[str], df: DataFrame) -> list[Column]:
    return [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]


def shard_rows(df: DataFrame, cfg: ShardConfig = ShardConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, shard, slot) for every row of ``df``: the whole row as one column, exchanged once, sorted by slot in ranges.

    A null id orders as the least id.  Rows equal in id and text stay in one shard and may
    take each other's slots.  Copies of one text share a shard unless near equal bytes need a
    cut among them.  Fewer rows than shards leave shards empty; no rows give no rows.
    """
    scratch = Scratch(df.sparkSession, "shards")
    K.small_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = [F.xxhash64(body).alias("h"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LOW)).alias("doc_id")]
    keys = scratch.keep(df.select(*key, (F.octet_length(body) + 8).cast("long").alias("size")), "keys")
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = total / cfg.shards
    cuts = find_cuts(keys, n, total, [per * i for i in range(1, cfg.shards)], per, cfg) if n else []
    ends = [_as_pair(min(c[0], (1 << 128) - 1)) for c in cuts]
    # the shard is the number of cuts at or below the key
    at = sum(((F.col("h") > h) | ((F.col("h") == h) & (F.col("doc_id") >= i))).cast("int") for h, i in ends) if ends else F.lit(0)
    ranges = max(1, -(-n // (cfg.shards * cfg.range_rows)), -(-total // (cfg.shards * cfg.range_bytes)))
    part = (at * ranges + F.pmod(F.xxhash64(F.lit("range"), "h", "doc_id"), F.lit(ranges))).cast("int")

    # the first slot of every range, by one count; a window over the ranges of one shard
    counted = keys.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = W.partitionBy(F.floor(F.col("part") / ranges)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counted.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(whole, *key)
    dealt = rows.select(part.alias("part"), F.lit(1).alias("role"), "h", "doc_id", F.lit(None).cast("long").alias("first"), "row")
    heads = first.select("part", F.lit(0).alias("role"), *_nulls(["h", "doc_id"], dealt), "first", *_nulls(["row"], dealt))
    turn = W.partitionBy("part").orderBy("role", "h", "doc_id")
    placed = heads.unionByName(dealt).repartitionById(cfg.shards * ranges, F.col("part")).withColumn("place", F.row_number().over(turn))
    placed = placed.withColumn("first", F.first("first").over(turn.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return placed.where("role = 1").select("row", F.floor(F.col("part") / ranges).cast("int").alias("shard"), (F.col("first") + F.col("place") - 2).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, cfg: ShardConfig = ShardConfig(), doc_id: str = "doc_id", text: str = "text") -> None:
    """The documents as parquet files, a folder a shard, in the columns of ``df`` and ``slot``, each file in its order."""
    shard_rows(df, cfg, doc_id, text).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], "shard", "slot").write.partitionBy("shard").parquet(path)


def shard(df: DataFrame, cfg: ShardConfig = ShardConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SHARDED for every row of ``df``, from the rows as they stand in their shards: the law is ``bytes``.

    A row's size is the UTF-8 bytes of its text plus 8; a null text has none and the
    CRC of no bytes; a null id stays null.  ``shard_rows`` says the rest.
    """
    made = Scratch(df.sparkSession, "shards").keep(shard_rows(df, cfg, doc_id, text), "rows")
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    values = {
        "doc_id": F.col(f"row.`{doc_id}`"), "size": F.octet_length(body) + 8, "text_crc32": F.crc32(body), "law": F.lit("bytes"),
        "shard": F.col("shard"), "slot": F.col("slot"), "grown_shard": F.lit(None),
    }
    return made.select(*[values[name].cast(kind).alias(name) for name, kind in map(str.split, SHARDED.split(", "))])
