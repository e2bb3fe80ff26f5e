"""Language-model scores by masked pseudo-likelihood.

A small window network predicts a word from the two words on either side:
position embeddings are summed, pass a tanh, and an id's probability is the
product of that of its class and of its place in the class.  A document's score is
the sum over its words of the log probability given both sides (Besag's
pseudo-likelihood; Salazar et al., 2020, for masked models).

The vocabulary follows the corpus: there are as many classes as the fourth root of
the number of distinct words, so about as many ids as its square root.  Three in
four are single words, the most frequent; the others are shared by hash.  A word of a
shared id has its share of the id's probability: its count over that of
the id's words and one more, which stands for all words never seen.  Counts
of the most frequent such words are held by every task, the others met in a join.

What a network of this size cannot hold, passages that the corpus repeats, is kept by
a distributed memory: for every context (two words on either side) of the corpus the
counts of the words seen in it.  There the estimate backs off as Witten and Bell's (1991):
with N other occurrences of the context, a word seen in c of them has c / (N + 1), and any
other word the network's probability times 1 / (N + 1).  The network's part of a document's score is
its sum over all words times the share of words that were not seen elsewhere.  A caller may
ask for fewer contexts (``memory``): one in so many, chosen by its hash, then stands for the rest.
Contexts are dealt by their hash to units of about ``part`` words, as packed numbers in
order, and each unit is one task that counts its contexts.  What it finds goes back packed to the block of
texts that asked, where each text's log factors are summed.

Everything is learned from all documents.  Words are counted over the corpus, and
every text is written once as ids.  Texts are dealt to groups by a hash of id and text, in
an order of their own, and each group is one task: in a round it trains on the masked
words of its texts from the common parameters, and the groups' parameters are averaged by the
words they trained on.  Groups follow the corpus and the network alone, so the
result is the same however rows and tasks are dealt.  The rounds share out the words: each is
masked in one of them at least.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K
from quillon.scratch import Scratch, freed

OFFSETS = (-2, -1, 1, 2)
GAP = 2
#: Words of one pass through the network.  The last pass is filled up, so that a word's figures are the same at any place.
STEP = 4096


@dataclass(frozen=True)
class LMConfig:
    """side: classes, and ids of a class; None: the fourth root of the number of distinct words, 8 at least; own: share of the ids
    that single words have; held: next words by count whose counts every task holds; size: of the hidden layer; mask: over so many
    rounds, or all if they are fewer, the words are shared out, each to be trained on in one of them; span: words of a group for each
    parameter of the network; sums: parts that groups are added in; memory: one context in so many is remembered, 1: all, 0: none; part: kept contexts of a unit in
    which they meet; block: contexts that a task packs at once; broadcast: read no more, as nothing of the memory is sent to every task."""

    side: int | None = None
    own: float = 0.75
    held: int = 1 << 16
    size: int = 16
    rounds: int = 2
    mask: int = 2
    batch: int = 4096
    rate: float = 0.08
    span: int = 16
    sums: int = 16
    memory: int = 1
    part: int = 1 << 21
    block: int = 1 << 20
    broadcast: int = 1_000_000
    seed: int = 3


@dataclass(frozen=True)
class Vocabulary:
    """sorted, number: hashes of the single words and their ids; counts: of every id; less: log count and one more of a shared id, 0 of
    others; held, logs: sorted hashes and log counts of the next words.  Id 0 stands for a place beyond the text."""

    side: int
    sorted: np.ndarray
    number: np.ndarray
    counts: np.ndarray
    less: np.ndarray
    held: np.ndarray
    logs: np.ndarray

    @property
    def singles(self) -> int:
        return len(self.counts) - 1 - self.shared

    @property
    def shared(self) -> int:
        return int((self.less > 0).sum()) or 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        first = len(self.counts) - self.shared
        out = first + (h % np.uint64(self.shared)).astype(np.int32)
        at, known = _find(self.sorted, h)
        out[known] = self.number[at[known]]
        return out


def _find(among: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    if not len(among):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return at, among[at] == h


@dataclass(frozen=True)
class Model:
    """counted: (word, n) of all words; seen: OCCURRENCES of the contexts kept, in ``units`` units."""

    cfg: LMConfig
    vocabulary: Vocabulary
    parameters: dict[str, np.ndarray]
    counted: DataFrame
    seen: DataFrame
    units: int


def initial(counts: np.ndarray, side: int, cfg: LMConfig) -> dict[str, np.ndarray]:
    """Parameters whose prediction is the corpus's word frequencies, whatever the context."""
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    share = ((counts + 0.5) / (counts + 0.5).sum()).reshape(side, side)
    return {
        "embed": rng.normal(0, 0.1, (len(OFFSETS), side * side, cfg.size)).astype(np.float32),
        "bias": np.zeros(cfg.size, np.float32),
        "class_w": np.zeros((cfg.size, side), np.float32),
        "class_b": np.log(share.sum(axis=1)).astype(np.float32),
        "class_in": np.zeros((side, cfg.size), np.float32),
        "place_w": np.zeros((cfg.size, side), np.float32),
        "place_b": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def contexts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Values around every word, one row an offset; 0 beyond its text."""
    n = len(bounds) - 1
    at = np.arange(len(values)) + GAP * (np.repeat(np.arange(n), np.diff(bounds)) + 1)
    line = np.zeros(len(values) + GAP * (n + 2), values.dtype)
    line[at] = values
    return np.stack([line[at + o] for o in OFFSETS])


def masked(marks: np.ndarray, bounds: np.ndarray, turn: int, cfg: LMConfig) -> np.ndarray:
    """The words that a round trains on: by their text's mark and their place in it, so alike however the rows are dealt."""
    parts = max(1, min(cfg.mask, cfg.rounds))
    counts = np.diff(bounds)
    place = np.arange(bounds[-1], dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
    value = K.mix(np.repeat(marks, counts) + place * np.uint64(0x9E3779B97F4A7C15) + K.mix(np.array([cfg.seed * 1000], np.uint64))[0])
    return np.flatnonzero(value % np.uint64(parts) == turn % parts)


def _layers(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray):
    """Hidden layer, class input, classes, places, and both unnormalized log probability tables."""
    hidden = p["embed"][0].take(around[0], axis=0)
    for j in range(1, len(OFFSETS)):
        hidden += p["embed"][j].take(around[j], axis=0)
    hidden += p["bias"]
    np.tanh(hidden, out=hidden)
    kind = ids // p["class_b"].size
    given = hidden + p["class_in"].take(kind, axis=0)
    one = hidden @ p["class_w"]
    one += p["class_b"]
    two = given @ p["place_w"]
    two += p["place_b"].take(kind, axis=0)
    return hidden, given, kind, ids - kind * p["class_b"].size, one, two


def log_probability(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of every word given its context."""
    out = np.empty(-(-len(ids) // STEP) * STEP)
    fill = len(out) - len(ids)
    around, ids, rows = np.pad(around, ((0, 0), (0, fill))), np.pad(ids, (0, fill)), np.arange(STEP)
    for a in range(0, len(out), STEP):
        _, _, kind, place, one, two = _layers(p, around[:, a : a + STEP], ids[a : a + STEP])
        x = one[rows, kind].astype(float) + two[rows, place]
        np.exp(one, out=one)
        np.exp(two, out=two)
        out[a : a + STEP] = x - np.log(one.sum(axis=1)) - np.log(two.sum(axis=1))
    return out[: len(out) - fill]


class Trainer:
    """Adagrad steps on batches of (context, word)."""

    def __init__(self, p: dict[str, np.ndarray], cfg: LMConfig):
        self.p, self.cfg, self.n = {k: v.copy() for k, v in p.items()}, cfg, 0
        self.sum = {k: np.full(v.shape, 0.1, np.float32) for k, v in p.items()}

    def step(self, around: np.ndarray, ids: np.ndarray) -> None:
        p, m, side = self.p, len(ids), self.p["class_b"].size
        hidden, given, kind, place, d_one, d_two = _layers(p, around, ids)
        rows = np.arange(m)
        for d, true in ((d_one, kind), (d_two, place)):
            np.exp(d, out=d)
            d /= d.sum(axis=1, keepdims=True)
            d[rows, true] -= 1
        of_kind = np.zeros((m, side), np.float32)
        of_kind[rows, kind] = 1
        d_given = d_two @ p["place_w"].T
        d_pre = (d_given + d_one @ p["class_w"].T) * (1 - hidden * hidden)
        grads = {
            "class_w": hidden.T @ d_one, "class_b": d_one.sum(axis=0), "place_w": given.T @ d_two, "bias": d_pre.sum(axis=0),
            "class_in": of_kind.T @ d_given, "place_b": of_kind.T @ d_two,
        }
        scale = np.float32(1 / np.sqrt(m))
        for k, g in grads.items():
            g *= scale
            self.sum[k] += g * g
            p[k] -= self.cfg.rate * g / np.sqrt(self.sum[k])
        for j in range(len(OFFSETS)):  # only the rows that the batch has
            met, where = np.unique(around[j], return_inverse=True)
            g = np.stack([np.bincount(where, d_pre[:, i], len(met)) for i in range(d_pre.shape[1])], axis=1).astype(np.float32) * scale
            self.sum["embed"][j][met] += g * g
            p["embed"][j][met] -= self.cfg.rate * g / np.sqrt(self.sum["embed"][j][met])
        self.n += m


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _plain(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    K.small_batches(df.sparkSession)
    body = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(F.col(doc_id).cast("long"), body).alias("mark"))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n): the hash of every word of the corpus and its count; a task sends each of its words once a flush."""
    most = 1 << 21

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            words, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(words)
            words, n = words[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[first], np.add.reduceat(n, first)

        size = 0
        for whole in batches:
            for batch in K.chunks(whole):
                got = np.unique(K.Words(*K.buffers(batch.column(1))).hashes(), return_counts=True)
                held.append(got)
                size += len(got[0])
                if size > most:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1].astype(np.int64))], ["word", "n"])
                        held, size = [], 0
        if size:
            words, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return rows.select("doc_id", "text").mapInArrow(K.tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_words(counted: DataFrame, cfg: LMConfig) -> Vocabulary:
    """The vocabulary of a corpus from (word, n).  To the driver come ``held`` words and about as many as the square root of all."""
    side = cfg.side or max(8, math.ceil(counted.count() ** 0.25))
    singles = int(cfg.own * (side * side - 1))
    shared = side * side - 1 - singles
    top = counted.orderBy(F.desc("n"), "word").limit(singles + cfg.held).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(float)
    counts = np.zeros(side * side)
    counts[1 : min(singles, len(n)) + 1] = n[:singles]
    # the hash is unsigned: its remainder by way of its two halves
    low, high = F.col("word").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("word", 32)
    bucket = F.pmod(high * ((1 << 32) % shared) + low, F.lit(shared))
    for r in counted.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[singles + 1 + r.b] = r.n
    counts[singles + 1 :] -= np.bincount((words[:singles] % np.uint64(shared)).astype(int), n[:singles], shared)
    less = np.log(counts + 1)
    less[singles + 1 :] = np.maximum(less[singles + 1 :], 1e-300)  # an id without words is shared still
    less[: singles + 1] = 0
    order, next_ = np.argsort(words[:singles]), np.argsort(words[singles:])
    return Vocabulary(side, words[:singles][order], (order + 1).astype(np.int32), counts, less, words[singles:][next_], np.log(n[singles:][next_]))


ENCODED = "row long, doc_id long, mark long, n_tokens long, fixed double, ids binary, others array<long>, kept long"
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _hashed(around: np.ndarray) -> np.ndarray:
    value = np.full(around.shape[1], 0x165667B19E3779F9, np.uint64)
    for part in around:
        value = K.mix(value * _TURN + part)
    return value


def _remembered(around: np.ndarray, cfg: LMConfig) -> np.ndarray:
    """Places of the contexts that the memory has."""
    return np.flatnonzero(around % np.uint64(cfg.memory) == 0) if cfg.memory else np.empty(0, np.int64)


def _lists(values: np.ndarray, at: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list for each text of the values at sorted places."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pa.array(values, kind))


def encode(rows: DataFrame, vocabulary: Vocabulary, cfg: LMConfig) -> DataFrame:
    """ENCODED for every row of (doc_id, text, mark): ids of its words; ``fixed``, the sum of its words' log shares of their ids as far as
    a task knows them, and ``others``, the words whose counts it does not; ``kept``, how many of its contexts the memory has."""
    schema, shared = K.arrow_schema(ENCODED), rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = np.uint16 if vocabulary.side <= 256 else np.uint32

    def run(batches):
        v = shared.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in K.chunks(whole):
                spans = K.Words(*K.buffers(batch.column(1)))
                h, bounds = spans.hashes(), spans.bounds
                ids = v.ids(h)
                own = -v.less[ids]
                rare = np.flatnonzero(v.less[ids] > 0)
                at, known = _find(v.held, h[rare])
                own[rare[known]] += v.logs[at[known]]
                other = rare[~known]
                kept = spans.counts if cfg.memory == 1 else np.diff(np.searchsorted(_remembered(_hashed(contexts(h, bounds)), cfg), bounds))
                raw = ids.astype(kind).view(np.uint8)
                wide = np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + batch.num_rows)),
                        batch.column(0),
                        batch.column(2),
                        pa.array(spans.counts.astype(np.int64)),
                        pa.array(_sums(own, bounds)),
                        pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(raw)]),
                        _lists(h[other].view(np.int64), other, bounds, pa.int64()),
                        pa.array(kept.astype(np.int64)),
                    ],
                    schema=schema,
                )
                row += batch.num_rows

    return rows.select("doc_id", "text", "mark").mapInArrow(K.tidy(run), ENCODED)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of every text's values, taken from its own values alone."""
    out, some = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


def _ids(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of texts, and the first of every text (n+1)."""
    wide = 2 if side <= 256 else 4
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(np.uint16 if wide == 2 else np.uint32).astype(np.int32), (offs - offs[0]) // wide


def train(encoded: DataFrame, vocabulary: Vocabulary, cfg: LMConfig) -> dict[str, np.ndarray]:
    """Parameters learned from all encoded rows; no words leave the initial ones."""
    p = initial(vocabulary.counts, vocabulary.side, cfg)
    words = int(vocabulary.counts.sum())
    groups = max(1, -(-words // (cfg.span * pack(p).size)))
    for turn in range(cfg.rounds if words else 0):
        with freed(encoded.sparkSession):
            p = _train_round(encoded, groups, p, turn, cfg)
    return p


def _train_round(encoded: DataFrame, groups: int, p: dict[str, np.ndarray], turn: int, cfg: LMConfig) -> dict[str, np.ndarray]:
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    side = p["class_b"].size

    def learn(batches):
        trainer, left, group = Trainer(shared.value, cfg), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)[0].as_py()
            ids, bounds = _ids(batch.column(2), side)
            at = masked(batch.column(1).to_numpy().view(np.uint64), bounds, turn, cfg)
            around, picked = contexts(ids, bounds)[:, at], ids[at]
            if left is not None:
                around, picked = np.concatenate([left[0], around], axis=1), np.concatenate([left[1], picked])
            full = len(picked) // cfg.batch * cfg.batch
            for a in range(0, full, cfg.batch):
                trainer.step(around[:, a : a + cfg.batch], picked[a : a + cfg.batch])
            left = around[:, full:], picked[full:]
        if left is not None and len(left[1]):
            trainer.step(*left)
        if trainer.n:
            flat = (pack(trainer.p).astype(np.float64) * trainer.n).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([trainer.n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["g", "n", "sum"])

    def add(batches):
        n, total, part = 0, None, 0
        for b in batches:
            for g, weight, flat in zip(*(b.column(c).to_pylist() for c in range(3))):
                n, got, part = n + weight, np.frombuffer(flat, np.float32).astype(np.float64), g
                total = got if total is None else total + got
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["g", "n", "sum"])

    # one group a task, its texts in an order of their own; sums in the order of the groups
    dealt = encoded.where("n_tokens > 0").select(F.pmod("mark", F.lit(groups)).alias("g"), "mark", "ids", "doc_id").repartitionById(groups, F.col("g").cast("int"))
    made = dealt.sortWithinPartitions("mark", "doc_id").select("g", "mark", "ids").mapInArrow(K.tidy(learn), "g long, n long, sum binary")
    parts = min(groups, cfg.sums)
    summed = made.repartitionById(parts, F.pmod("g", F.lit(parts)).cast("int")).sortWithinPartitions("g").mapInArrow(K.tidy(add), "g long, n long, sum binary").collect()
    summed.sort(key=lambda r: r["g"] % parts)
    return unpack(sum(np.frombuffer(r["sum"]) for r in summed) / sum(r["n"] for r in summed), p)


#: One unit's contexts of a block of texts, in order: steps from one context to the next, and of each its word and the number of its text in the
#: block.  A block is known by the hash of its texts' marks; the marks are in its first row, and empty in the others.
OCCURRENCES = "unit long, block long, marks binary, context binary, word binary, text binary"
#: What a unit has found out for a block: of every context that stands elsewhere the number of its text, how often its word stands there elsewhere, and how often any does.
ANSWERS = "unit long, block long, marks binary, n long, text binary, here binary, others binary"
#: Bits of a context's hash that are kept, and those that its unit follows.
BITS, UNIT_BITS = 56, 32


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs."""
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _widen(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def _first(unit: int, units: int) -> int:
    """The least context of a unit."""
    return -(-(unit << UNIT_BITS) // units) << (BITS - UNIT_BITS)


def _packed(held: list[tuple[np.ndarray, ...]], units: int) -> pa.RecordBatch:
    """OCCURRENCES of (marks, contexts, words, texts) of some batches."""
    starts = np.cumsum([0, *[len(x[0]) for x in held]])
    marks, around, words = (np.concatenate([x[i] for x in held]) for i in range(3))
    texts = np.concatenate([x[3] + at for x, at in zip(held, starts)])
    block = int.from_bytes(blake2b(marks.tobytes(), digest_size=8).digest(), "little", signed=True)
    order = np.argsort(around, kind="stable")
    around, words, texts = around[order], words[order], texts[order]
    firsts = np.array([_first(u, units) for u in range(units)], np.uint64)
    cuts = np.append(np.searchsorted(around, firsts), len(around))
    out = []
    for u in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[u], cuts[u + 1])
        steps = np.diff(around[part], prepend=firsts[u])
        out.append((u, block, b"" if out else marks.tobytes(), _squeeze(steps), words[part].tobytes(), _squeeze(texts[part])))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), K.arrow_schema(OCCURRENCES).types)], schema=K.arrow_schema(OCCURRENCES))


def occurrences(rows: DataFrame, units: int, cfg: LMConfig) -> DataFrame:
    """OCCURRENCES of every context, of those the memory has, of (doc_id, text, mark)."""

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for batch in K.chunks(whole):
                spans = K.Words(*K.buffers(batch.column(1)))
                h = spans.hashes()
                around = _hashed(contexts(h, spans.bounds))
                at = _remembered(around, cfg)
                text = np.repeat(np.arange(batch.num_rows), spans.counts)
                held.append((batch.column(2).to_numpy(), around[at] >> np.uint64(64 - BITS), (h[at] >> np.uint64(32)).astype(np.uint32), text[at]))
                size += len(at)
                if size >= cfg.block:
                    yield _packed(held, units)
                    held, size = [], 0
        if size:
            yield _packed(held, units)

    return rows.select("doc_id", "text", "mark").mapInArrow(K.tidy(run), OCCURRENCES)


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, given which equal the one before (all but the first): the run of each, and the runs' sizes."""
    number = np.concatenate([[0], np.cumsum(~same)])
    return number, np.bincount(number)


def _met(around: np.ndarray, words: np.ndarray, corpus: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, in order, of the contexts asked for that stand elsewhere; how often with their word, and with any.  corpus: which of a unit's
    contexts count; asked: which are asked for; what is both does not count for itself."""
    order = np.argsort(around)
    same = np.diff(around[order]) == 0
    if not same.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # most contexts stand once
    order = order[np.lexsort((words[order], around[order]))]
    around, words, corpus, asked = (x[order] for x in (around, words, corpus, asked))
    same = around[1:] == around[:-1]
    of, _ = _runs(same)
    by, _ = _runs(same & (words[1:] == words[:-1]))
    own = (corpus & asked).astype(np.int64)
    others, here = np.bincount(of, corpus).astype(np.int64)[of] - own, np.bincount(by, corpus).astype(np.int64)[by] - own
    hit = np.flatnonzero(asked & (others > 0))
    hit = hit[np.argsort(order[hit])]
    return order[hit], here[hit], others[hit]


def _answers(seen: DataFrame, asked: DataFrame | None, units: int) -> DataFrame:
    """ANSWERS, at most one for each of the OCCURRENCES asked for; the other arguments as in ``_backed_off``."""
    flag = lambda df, corpus: df.withColumn("corpus", F.lit(corpus))
    rows = flag(seen, True) if asked is None else flag(seen, True).union(flag(asked, False))
    own, schema = asked is None, K.arrow_schema(ANSWERS)

    def run(batches):
        held, rows = [], []
        for batch in batches:
            for unit, block, marks, around, words, text, corpus in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(words, np.uint32)
                n = len(words)
                around = np.cumsum(_widen(around, n), dtype=np.uint64) + np.uint64(_first(unit, units))
                held.append((around, words, np.full(n, corpus), np.full(n, own or not corpus)))
                rows.append((unit, block, marks, text) if own or not corpus else None)
        if not held:
            return
        starts = np.cumsum([0, *[len(x[0]) for x in held]])
        at, here, others = _met(*(np.concatenate([x[i] for x in held]) for i in range(4)))
        del held
        cuts, out = np.searchsorted(at, starts), []
        for i, row in enumerate(rows):
            n = int(cuts[i + 1] - cuts[i])
            if row and (n or row[2]):
                part = slice(cuts[i], cuts[i + 1])
                text = _widen(row[3], int(starts[i + 1] - starts[i]))[at[part] - starts[i]]
                out.append((*row[:3], n, _squeeze(text), _squeeze(here[part]), _squeeze(others[part])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.repartitionById(units, F.col("unit").cast("int")).mapInArrow(K.tidy(run), ANSWERS)


def _backed_off(seen: DataFrame, asked: DataFrame | None, units: int) -> DataFrame:
    """(mark, met, factor): at how many of a text's contexts its word was seen there elsewhere, and the sum of the log factors of all.

    seen: OCCURRENCES of the corpus; asked: those of other texts, or None for the corpus's own, each of which is not elsewhere
    to itself.  Rows of one mark are summed together.
    """
    ddl = "mark long, met long, factor double"
    schema = K.arrow_schema(ddl)

    def add(block: pa.Table) -> pa.Table:
        # by unit, so in the order of the contexts: a text's sum is the same in any block
        rows = sorted(block.to_pylist(), key=lambda r: r["unit"])
        marks = next((r["marks"] for r in rows if r["marks"]), None)
        if marks is None:
            raise RuntimeError("a block's marks are missing: the input gave other rows, or another order of them, when a lost part was made again")
        marks = np.frombuffer(marks, np.int64)
        texts, here, others = (np.concatenate([_widen(r[k], r["n"]) for r in rows]).astype(np.int64) for k in ("text", "here", "others"))
        met = np.bincount(texts, here > 0, len(marks)).astype(np.int64)
        factor = np.bincount(texts, np.log(np.maximum(here, 1)) - np.log(others + 1), len(marks))
        some = np.bincount(texts, minlength=len(marks)) > 0
        return pa.Table.from_arrays([pa.array(x[some]) for x in (marks, met, factor)], schema=schema)

    made = _answers(seen, asked, units).groupBy("block").applyInArrow(add, ddl)
    return made.groupBy("mark").agg(F.sum("met").alias("met"), F.sum("factor").alias("factor"))


SCORED = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"


def _score(encoded: DataFrame, model: Model, asked: DataFrame | None, scratch: Scratch, spent: tuple[str, ...]) -> DataFrame:
    """SCORED of encoded rows.  asked: their occurrences; None: they are those that the model was learned from, so each context's own is left out.
    spent: tables of the scratch folder that go as soon as the network's part is written, before contexts meet."""
    spark, side = encoded.sparkSession, model.vocabulary.side
    ddl = "row long, doc_id long, n_tokens long, network double, kept long, mark long"
    schema, shared = K.arrow_schema(ddl), spark.sparkContext.broadcast(model.parameters)

    def run(batches):
        for batch in batches:
            ids, bounds = _ids(batch.column(4), side)
            each = log_probability(shared.value, contexts(ids, bounds), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_sums(each, bounds) + batch.column(3).to_numpy()), *batch.columns[5:]], schema=schema)

    K.small_batches(spark)
    value = lambda c: F.coalesce(c, F.lit(0.0))
    with freed(spark):
        made = encoded.select("row", "doc_id", "n_tokens", "fixed", "ids", "kept", "mark").mapInArrow(K.tidy(run), ddl)
        # words counted once, and those never seen, add a log count of 0
        words = encoded.select("row", F.explode("others").alias("word")).join(model.counted.where("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        made = made.join(words, "row", "left").select("doc_id", "n_tokens", (F.col("network") + value("more")).alias("network"), "kept", "mark")
        made = scratch.keep(made, "network")
    scratch.drop(*spent)
    if model.cfg.memory:
        # written, so that the packed contexts go; rows of one id and text have one mark, and each its share of what they have together
        rows = made.groupBy("mark").agg(F.count("*").alias("rows"))
        with freed(spark):
            met = scratch.keep(_backed_off(model.seen, asked, model.units), "met")
        found = met.join(rows, "mark").select("mark", (F.col("met") / F.col("rows")).alias("met"), (F.col("factor") / F.col("rows")).alias("factor"))
        made = made.join(found, "mark", "left")
    else:
        made = made.withColumns({"met": F.lit(0.0), "factor": F.lit(0.0)})
    kept = F.greatest("kept", F.lit(1))
    both = F.col("network") * (1 - value("met") / kept) + value("factor") * F.col("n_tokens") / kept
    # sums of doubles in any order agree to far more digits than these
    out = made.withColumn("log_prob", F.round(both, 6))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def _fit(df: DataFrame, cfg: LMConfig, doc_id: str, text: str, scratch: Scratch, keep: bool) -> tuple[Model, DataFrame]:
    """keep: the occurrences are written; else they are made when they are met, once."""
    rows = _plain(df, doc_id, text)
    with freed(df.sparkSession):
        counted = scratch.keep(count_words(rows), "words")
    vocabulary = learn_words(counted, cfg)
    encoded = scratch.keep(encode(rows, vocabulary, cfg), "encoded")
    parameters = train(encoded, vocabulary, cfg)
    units = max(1, -(-int(vocabulary.counts.sum()) // (cfg.part * max(1, cfg.memory))))
    seen = occurrences(rows, units, cfg)
    return Model(cfg, vocabulary, parameters, counted, scratch.keep(seen, "seen") if keep else seen, units), encoded


def fit(df: DataFrame, cfg: LMConfig = LMConfig(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model learned from all rows; its tables are in the shared folder."""
    return _fit(df, cfg, doc_id, text, Scratch(df.sparkSession, "lm"), bool(cfg.memory))[0]


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCORED for every row of other documents: the summed log probability of its words, and their mean (null without words).

    A null text counts as empty and has 0; repeated rows and null ids are scored one by
    one, ties are no matter, other columns are not read, no rows give no rows.  A document that the
    model was learned from is better scored by ``score_documents``, which leaves its own contexts out.
    """
    scratch = Scratch(df.sparkSession, "lm")
    rows = _plain(df, doc_id, text)
    encoded = scratch.keep(encode(rows, model.vocabulary, model.cfg), "encoded")
    return _score(encoded, model, occurrences(rows, model.units, model.cfg), scratch, ("encoded",))


def score_documents(df: DataFrame, cfg: LMConfig = LMConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on all rows of ``df`` and score them, as ``score`` does, with each row's own contexts left out of the memory."""
    scratch = Scratch(df.sparkSession, "lm")
    model, encoded = _fit(df, cfg, doc_id, text, scratch, False)
    return _score(encoded, model, None, scratch, ("encoded", "words"))
