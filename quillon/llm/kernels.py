"""Array kernels over Arrow string columns: words, hashes and shingles without a Python loop per word.

A column's bytes are read in place.  Words are maximal runs of "word" bytes; as
all separators are ASCII, this is the same as splitting by code points.  A word's
64-bit hash takes its bytes in blocks of eight, each passed through an avalanche
with what came before; a span of over ``LONG`` bytes is hashed by BLAKE2b.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one pass of array operations works on; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Rows of one Arrow batch between the JVM and Python, so that a batch of long texts stays small.
BATCH_ROWS = 1024

_SEED = np.random.Generator(np.random.PCG64(20240229))
_TURN = _SEED.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The first 0..8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a span up to which its blocks are hashed here, many spans at a time.
LONG = 256


def _table(outside: bytes, ascii_only_outside: bool = False) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Word bytes when white space separates: all but 09-0D and 20.
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Word bytes when all ASCII but letters and digits separates (upper-case letters are lowered before).
ALNUM = _table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of the bytes of every span; equal bytes have equal values wherever they stand."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _TURN[2] + _TURN[3])
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    blocks = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))  # the eight bytes from every place on
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    open_ = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[open_], size[open_]
    while len(open_):
        out[open_] = mix((out[open_] ^ (blocks[at] & _FIRST[np.minimum(left, 8)])) * _TURN[4] + _TURN[5])
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: Byte classes that separate runs of letters and digits (1) from runs of other signs (2); 0 is white space.
CLASSES = np.where(SPACED, np.where(ALNUM, 1, 2), 0).astype(np.uint8)


class Words:
    """Words of some texts: byte spans, and ``bounds`` with the first word of every text (n+1).

    table: truth or a class of every byte; a word is a maximal run of one class other than 0.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACED):
        kind = np.zeros(len(raw) + 2, np.uint8)
        kind[1:-1] = table[raw]
        own = kind[1:-1]
        edge_start = (own != kind[:-2]) & (own > 0)
        edge_end = (own != kind[2:]) & (own > 0)
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        edge_start[cut] = own[cut] > 0
        edge_end[cut - 1] = own[cut - 1] > 0
        self.raw, self.offs = raw, offs
        self.starts = np.flatnonzero(edge_start)
        self.ends = np.flatnonzero(edge_end) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit value of every word."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        return span_hashes(LOWER[self.raw] if lower else self.raw, self.starts, self.ends)

    def documents(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A value of the k hashes from each place on; len(h) - k + 1 values."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _TURN[0]
        out += h[i : i + n]
    return mix(out)


def shingle_sets(words: Words, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every text, and n+1 offsets.

    A text of fewer words has its whole sequence as one shingle; a text without
    words has none.
    """
    h = words.hashes(lower)
    n = len(words.counts)
    sizes = np.where(words.counts >= k, words.counts - k + 1, (words.counts > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offs[-1], np.uint64)
    full = windows(h, k)
    for i in range(n):
        a, b = words.bounds[i], words.bounds[i + 1]
        to = out[offs[i] : offs[i + 1]]
        if b - a >= k:
            to[:] = full[a : b - k + 1]
            to.sort()
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    value = value * _TURN[1] + x
            to[0] = mix(np.array([value]))[0]
    if not len(out):
        return out, offs
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[offs[:-1][sizes > 0]] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], at[offs]


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` whose function sees batches with bounded bytes of text."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column, most):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(tidy(run), schema)


def tidy(run):
    """The Arrow function, after which the worker gives unused memory back: workers idle beside the JVM until they are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries have none
            if trim is not None:
                trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string of the plain types used here."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


def spans_to_code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n, the number of code points that begin before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
