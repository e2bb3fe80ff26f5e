"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

Two documents are linked when ``100 * |A & B| >= 75 * |A | B|`` for their sets of
five-word shingles (A-Z lowered, white space separates).  The result gives every
document the smallest id it can reach over links.

Steps, each a distributed job over all rows:

1. *Sign.*  Every text gives its set size, a 128-bit value of the set, 32 band
   keys of 4 MinHash values each (a pair at 0.75 shares no band with a chance
   of 5e-6), and an odd sketch (Mitzenmacher, Pagh and Pham, 2014): its MinHash
   sample folded into a 2048-bit parity map.  The sample is the minima of 1024 hash
   bins, or the whole set where that has at most 1024 values.  The XOR of two maps
   counts the values in which two samples differ.
2. *Collapse.*  Documents with equal sets are one class with a number of its own; a
   group of copies of any size is one row from here on.
3. *Stars.*  In each band bucket every class is paired with the bucket's
   first: linear in the bucket.  Pairs that the sketches rule out go; the others are
   confirmed on the full sets.
4. *Families.*  Classes joined by pairs that the sketches let pass are a family.
   Where a family lies in several components, its members outside the largest are
   compared with all of it, in units of bounded size that hold the texts; only
   links that join something are put out.
5. *Crossings.*  Members of one bucket but of different families are compared on
   their sketches, in such units too, and what may be a link is confirmed.  So
   every pair that shares a bucket has been met.

What the sketches rule out: an XOR count is never above the number of values in
which two samples differ, so between whole sets a count above the difference that
the threshold allows is proof.  Between bin minima, sets of over 1024 values, the
estimate must be under 0.75 less ``slack``, seven standard errors.  A whole set
against bin minima is never ruled out.

Groups whose key may be hot (buckets, families, hubs) are counted and joined by
(key, salt of the member), so one key's rows are spread over tasks.

Defined results: a null or empty text, or one without words, has no shingles, is
linked with nothing and is its own component.  Rows that repeat a ``doc_id`` are
each classed by their own text, whatever the order of rows.  A row with a null
``doc_id`` takes its component's smallest id, or null if no row has one, and is not
kept.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillon.llm import kernels as K
from quillon.operators.graph import connected_components
from quillon.scratch import Scratch

BINS, BITS = 1024, 2048


@dataclass(frozen=True)
class DedupConfig:
    """words: of a shingle; percent: least similarity; bands x rows MinHash values."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    slack: float = 0.15
    block: int = 512  # members on one side of a unit, and
    volume: int = 1 << 21  # shingles on it, about
    seed: int = 7


#: Parts that one key's rows are counted and joined in.
SPREAD = 256
#: Tasks that one hub's partners are confirmed in, at most.
HUB_PARTS = 4096

SIGNED = "doc_id long, mark long, n_shingles long, set_a long, set_b long, bins int, sketch binary, bands array<long>"


def _multipliers(cfg: DedupConfig) -> np.ndarray:
    made = np.random.Generator(np.random.PCG64(cfg.seed)).integers(1, 2**63, cfg.bands * cfg.rows, dtype=np.uint64)
    return made * np.uint64(2) + np.uint64(1)


def odd_sketches(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity maps (n x BITS/8 bytes) of the samples of sorted hash sets, and the size of each sample.

    A sample is the set itself up to BINS values, and the minima of BINS bins beyond.
    """
    n, sizes = len(offs) - 1, np.diff(offs)
    owner = np.repeat(np.arange(n), sizes)
    cell = owner * BINS + (h >> np.uint64(64 - 10)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]  # the sets are sorted, so a bin's first value is its minimum
    first |= sizes[owner] <= BINS
    owner, kept = owner[first], K.mix(h[first] ^ np.uint64(0x9E3779B97F4A7C15))
    flips = np.bincount(owner * BITS + (kept % np.uint64(BITS)).astype(np.int64), minlength=n * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, BITS), axis=1), np.bincount(owner, minlength=n)


def sketch_similarity(x: np.ndarray, y: np.ndarray, bins_x, bins_y, size_x, size_y) -> np.ndarray:
    """Estimated resemblance from XOR population counts of maps given as uint64 words (last axis); 1 where one sample is a whole set and the other not."""
    odd = np.bitwise_count(x ^ y).sum(axis=-1).astype(float)
    differ = -0.5 * BITS * np.log(np.maximum(1 - 2 * odd / BITS, 1e-3))
    size_x, size_y = np.asarray(size_x), np.asarray(size_y)
    both = size_x.astype(float) + size_y
    guess = np.full(np.shape(odd), 0.75)
    for _ in range(6):  # the union's occupied bins depend on its size, and so on the answer
        union = BINS * -np.expm1(both / (1 + guess) * np.log1p(-1 / BINS))
        guess = np.minimum(np.maximum((bins_x + bins_y - differ) / 2, 0) / np.maximum(union, 1e-9), 1.0)
    whole = np.maximum(both - differ, 0) / np.maximum(both + differ, 1e-9)
    small_x, small_y = size_x <= BINS, size_y <= BINS
    return np.where(small_x & small_y, whole, np.where(small_x | small_y, 1.0, guess))


def may_link(x: np.ndarray, y: np.ndarray, bins_x, bins_y, size_x, size_y, cfg: DedupConfig) -> np.ndarray:
    """Whether the sizes and the sketches leave a link open.

    Linked sets of sizes a and b differ in (a + b)(1 - j)/(1 + j) values at most, j the least similarity.
    """
    size_x, size_y = np.asarray(size_x), np.asarray(size_y)
    odd = np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)
    proof = odd * (100 + cfg.percent) > (size_x + size_y) * (100 - cfg.percent)
    sampled = (size_x > BINS) & (size_y > BINS)
    likely = sketch_similarity(x, y, bins_x, bins_y, size_x, size_y) >= cfg.percent / 100 - cfg.slack
    ruled_out = np.where(sampled, ~likely, proof & (size_x <= BINS) & (size_y <= BINS))
    return ~ruled_out & (100 * np.minimum(size_x, size_y) >= cfg.percent * np.maximum(size_x, size_y))


def sign(df: DataFrame, cfg: DedupConfig, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of SIGNED for every row of ``df``; ``mark`` is a hash of the text."""
    schema, mult = K.arrow_schema(SIGNED), _multipliers(cfg)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = K.Words(*K.buffers(batch.column(1)))
        h, offs = K.shingle_sets(words, cfg.words)
        n, sizes = batch.num_rows, np.diff(offs)
        full = np.flatnonzero(sizes)
        keys = np.zeros((len(full), cfg.bands), np.uint64)
        a = np.zeros(n, np.uint64)
        b = np.zeros(n, np.uint64)
        if len(full):
            at = offs[:-1][full]
            a[full] = np.add.reduceat(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
            b[full] = np.add.reduceat(K.mix(h + np.uint64(0x14057B7EF767814F)), at)
            for band in range(cfg.bands):
                key = np.full(len(full), band + 1, np.uint64)
                for m in mult[band * cfg.rows : (band + 1) * cfg.rows]:
                    key = K.mix(key * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(h * m, at))
                keys[:, band] = key
        maps, bins = odd_sketches(h, offs)
        held = np.zeros(n, np.int64)
        held[full] = cfg.bands
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(sizes, pa.int64()),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.array(bins.astype(np.int32)),
                pa.array([m.tobytes() for m in maps], pa.binary()),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64))).cast(schema.field("bands").type),
            ],
            schema=schema,
        )

    return K.map_text(_rows(df, doc_id, text), work, SIGNED)


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("mark"))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _maps(batch: pa.RecordBatch, name: str) -> np.ndarray:
    joined = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(batch.num_rows, BITS // 64)


def _salt(member: str) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(SPREAD)).alias("salt")


def _with_totals(rows: DataFrame, key: str, member: str, totals: dict) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``salt``, and a row for each (key, salt) with the key's totals, to be joined on both.

    totals: name -> (aggregate of a part, aggregate of parts).  Between count and
    join a key has SPREAD rows at most, so a key of any number of rows is in many tasks.
    """
    salted = rows.withColumn("salt", _salt(member))
    parts = salted.groupBy(key, "salt").agg(*[part.alias(name) for name, (part, _) in totals.items()])
    whole = W.partitionBy(key)
    summed = parts.select(key, "salt", *[over(name).over(whole).alias(name) for name, (_, over) in totals.items()])
    return salted, summed


def _near(pairs: DataFrame, signed: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule a link out."""
    side = lambda x: signed.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"), F.col("sketch").alias(f"map_{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = may_link(_maps(batch, "map_a"), _maps(batch, "map_b"), _column(batch, "bins_a"), _column(batch, "bins_b"), _column(batch, "n_a"), _column(batch, "n_b"), cfg)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(got))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {cfg.percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "bins_a", "map_a", "n_b", "bins_b", "map_b").mapInArrow(K.tidy(run), "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """The pairs (a, b) that are links on their full shingle sets.

    A pair travels with b's text to a's text.  The texts that meet one ``a`` are
    dealt to blocks of about ``cfg.block`` (to HUB_PARTS blocks at most) by a salt,
    with a copy of a's text in each, so a hub with many partners is spread over tasks.
    A task holds the set of one ``a`` and meets the others one by one.
    """
    salted, hubs = _with_totals(pairs, "a", "b", {"n": (F.count("*"), F.sum)})
    blocks = F.least(F.ceil(F.col("n") / cfg.block), F.lit(HUB_PARTS))
    members = salted.join(hubs, ["a", "salt"]).select("a", F.pmod(F.xxhash64(F.lit("block"), "b"), blocks).alias("salt"), F.col("b").alias("id"), F.lit(1).alias("role"))
    centres = hubs.groupBy("a").agg(F.first("n").alias("n")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("role"))
    rows = members.union(centres).join(texts, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    k, percent = cfg.words, cfg.percent
    K.small_batches(pairs.sparkSession)

    def run(batches):
        centre, own = None, None
        for whole in batches:
            for batch in K.chunks(whole):
                h, offs = K.shingle_sets(K.Words(*K.buffers(batch.column(batch.schema.get_field_index("text")))), k)
                a, role, doc = _column(batch, "a"), _column(batch, "role"), _column(batch, "id")
                got = []
                for i in range(batch.num_rows):
                    mine = h[offs[i] : offs[i + 1]]
                    if role[i] == 0:
                        centre, own = a[i], mine.copy()
                    elif a[i] == centre and len(mine) and len(own):
                        if _linked(own, mine, percent):
                            got.append((centre, doc[i]))
                if got:
                    x = np.array(got, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return rows.select("a", "salt", "role", "id", "text").mapInArrow(K.tidy(run), "a long, b long")


def _blocks(members: DataFrame, part: str, least: int, cfg: DedupConfig) -> DataFrame:
    """Members (key, id, size, <part>) dealt to units of work that meet every pair of a key with different parts.

    In a key's group the members outside its largest part are the minor ones; these
    and all members are cut into blocks of about ``cfg.block`` members and ``cfg.volume``
    shingles by a hash, and a block of minor ones with a block of all is one unit (key, i, j).
    Groups of one part, or of fewer than ``least`` members, have no units.
    """
    parts = members.groupBy("key", part).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("volume").alias("volume"), F.max_by(F.struct(part, "volume"), F.struct("n", part)).alias("main"))
    mixed = mixed.where(F.col("most") < F.col("n")).where(F.col("n") >= least)
    blocks = lambda n, volume: F.greatest(F.ceil(n / cfg.block), F.ceil(volume / cfg.volume)).cast("long")
    mixed = mixed.select("key", F.col(f"main.{part}").alias("main"), blocks(F.col("n"), F.col("volume")).alias("blocks"),
                         blocks(F.col("n") - F.col("most"), F.col("volume") - F.col("main.volume")).alias("others"))
    salted = members.withColumn("salt", _salt("id"))
    rows = salted.join(salted.select("key", "salt").distinct().join(mixed, "key"), ["key", "salt"]).withColumn("h", F.xxhash64("id"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = rows.select("key", F.pmod("h", "blocks").alias("i"), each("others").alias("j"), "id", part, F.lit(0).alias("minor"))
    minor = rows.where(F.col(part) != F.col("main")).select("key", each("blocks").alias("i"), F.pmod("h", "others").alias("j"), "id", part, F.lit(1).alias("minor"))
    return whole.union(minor)


def _by_unit(dealt: DataFrame, within) -> DataFrame:
    """Rows (key, i, j, ...) gathered by unit; ``within`` makes pairs (a, b) of each unit's batch."""
    K.small_batches(dealt.sparkSession)

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(found, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x.min(axis=1)), pa.array(x.max(axis=1))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.zeros(batch.num_rows, bool)
            for name in ("key", "i", "j"):
                v = _column(batch, name)
                cuts[1:] |= v[1:] != v[:-1]
                cuts[0] |= bool(held) and v[0] != _column(held[-1], name)[-1]
            at = 0
            for cut in np.flatnonzero(cuts).tolist():
                held.append(batch.slice(at, cut - at))
                if found := within(_joined(held)):
                    yield pairs(found)
                held, at = [], cut
            held.append(batch.slice(at))
        if held and (found := within(_joined(held))):
            yield pairs(found)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(K.tidy(run), "a long, b long")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows] or parts[:1]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _family_links(members: DataFrame, texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Links between components of one family, as few as join what is linked within each unit.

    members: (key, id, size, component).  A unit holds its texts; what the sketches do
    not rule out is checked on the full sets there and then, likeliest first, and a
    pair whose components the unit has already joined is passed over.
    """
    percent, k = cfg.percent, cfg.words

    def within(unit: pa.RecordBatch) -> list[tuple[int, int]]:
        doc, label, minor = _column(unit, "id"), _column(unit, "component").copy(), _column(unit, "minor")
        rest, small = np.flatnonzero(minor == 0), np.flatnonzero(minor == 1)
        if not len(small) or not len(rest):
            return []
        sets: list[np.ndarray] = []
        maps, bins = [], []
        for part in K.chunks(unit.select(["text"])):
            h, offs = K.shingle_sets(K.Words(*K.buffers(part.column(0))), k)
            m, occupied = odd_sketches(h, offs)
            maps.append(np.ascontiguousarray(m).view(np.uint64))
            bins.append(occupied)
            sets += [h[a:b] for a, b in zip(offs[:-1], offs[1:])]
        maps, bins, size = np.concatenate(maps), np.concatenate(bins), np.array([len(x) for x in sets])
        out = []
        for x in small:
            y = rest[label[rest] != label[x]]
            if len(y):
                y = y[may_link(maps[y], maps[x], bins[y], bins[x], size[y], size[x], cfg)]
            if not len(y):
                continue
            got = sketch_similarity(maps[y], maps[x], bins[y], bins[x], size[y], size[x])
            for j in y[np.argsort(-got, kind="stable")]:
                if label[j] != label[x] and _linked(sets[x], sets[j], percent):
                    out.append((doc[x], doc[j]))
                    label[label == label[j]] = label[x]
        return out

    return _by_unit(_blocks(members, "component", 3, cfg).join(texts, "id").select("key", "i", "j", "id", "component", "minor", "text"), within)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _crossings(members: DataFrame, signed: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Pairs of different families that share a bucket and may be links; a pair comes from its first common band.

    members: (key, id, size, family), key a bucket.
    """

    def within(unit: pa.RecordBatch) -> list[tuple[int, int]]:
        doc, family, minor, size, bins = (_column(unit, c) for c in ("id", "family", "minor", "n_shingles", "bins"))
        key, out = unit.column(0)[0].as_py(), []
        rest, small = np.flatnonzero(minor == 0), np.flatnonzero(minor == 1)
        if not len(small) or not len(rest):
            return out
        maps = _maps(unit, "sketch")
        bands = np.array(unit.column(unit.schema.get_field_index("bands")).to_pylist(), np.int64)
        for x in small:
            y = rest[family[rest] != family[x]]
            if len(y):
                y = y[may_link(maps[y], maps[x], bins[y], bins[x], size[y], size[x], cfg)]
            if len(y):
                first = (bands[y] == bands[x]).argmax(axis=1)
                out += [(doc[x], doc[j]) for j in y[bands[x][first] == key]]
        return out

    # these rows hold no texts, so a block is bounded by its members alone
    rows = _blocks(members.withColumn("size", F.lit(0)), "family", 2, cfg).join(signed.select("id", "n_shingles", "bins", "sketch", "bands"), "id")
    return _by_unit(rows.select("key", "i", "j", "id", "family", "minor", "n_shingles", "bins", "sketch", "bands"), within).distinct()


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) for the rows (id, doc_id, mark) wanted."""
    w = wanted.select("id", F.col("doc_id").alias("w_doc"), F.col("mark").alias("w_mark"))
    met = rows.join(w, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("mark") == F.col("w_mark")))
    return met.groupBy("id").agg(F.first("text").alias("text"))  # rows that repeat id and text


_SET = ["set_a", "set_b", "n_shingles"]


def near_duplicates(df: DataFrame, cfg: DedupConfig = DedupConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``df``; see the module's text."""
    scratch = Scratch(df.sparkSession, "dedup")
    signed = scratch.keep(sign(df, cfg, doc_id, text), "signed")
    same = [F.first(c).alias(c) for c in ("bins", "sketch", "bands")]  # equal sets have equal ones
    one = signed.where("n_shingles > 0").groupBy(*_SET).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("doc_id", "mark")).alias("row"), *same)
    # the numbers are only names: they are written with the classes, and no result depends on their order
    classes = scratch.keep(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    plain = classes.select("id", "n_shingles", "bins", "sketch")

    salted, shared = _with_totals(classes.select(F.explode("bands").alias("key"), "id"), "key", "id", {"head": (F.min("id"), F.min), "tail": (F.max("id"), F.max)})
    members = scratch.keep(salted.join(shared.where("head < tail"), ["key", "salt"]).select("key", "head", "id"), "members")
    wanted = members.select("id").distinct().join(classes.select("id", "row.doc_id", "row.mark"), "id")
    texts = scratch.keep(_texts(_rows(df, doc_id, text), wanted), "texts")

    tried = scratch.keep(_near(members.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), plain, cfg), "tried-stars")
    links = scratch.keep(confirm(tried, texts, cfg), "links-stars")
    found = scratch.keep(connected_components(links, scratch), "components-stars")
    families = scratch.keep(connected_components(tried, scratch), "families")
    place = lambda rows, groups, name: rows.join(groups.select("id", F.col("component").alias(name)), "id", "left").withColumn(name, F.coalesce(name, "id"))
    kin = place(families.select("id", F.col("component").alias("key")), found, "component").join(classes.select("id", F.col("n_shingles").alias("size")), "id")
    within = scratch.keep(_family_links(kin, texts, cfg), "links-families")
    more = scratch.keep(_crossings(place(members.select("key", "id"), families, "family"), classes.select("id", "n_shingles", "bins", "sketch", "bands"), cfg), "tried-crossings")
    across = scratch.keep(confirm(more, texts, cfg), "links-crossings")
    if not (within.isEmpty() and across.isEmpty()):
        # only the components that the new links touch are worked on again
        ends = lambda df: place(place(df.withColumnRenamed("a", "id"), found, "u").select("u", F.col("b").alias("id")), found, "v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        joined = scratch.keep(connected_components(ends(within.union(across)), scratch), "components-joined")
        lone = joined.join(found.select("id"), "id", "left_anti")
        moved = found.withColumnRenamed("component", "was").join(joined.select(F.col("id").alias("was"), "component"), "was", "left")
        found = scratch.keep(moved.select("id", F.coalesce("component", "was").alias("component")).union(lone), "components")

    # the smallest doc_id of a component is that of its classes; a class of one row without a link is its row's own
    linked = classes.select("id", "least", "n", *_SET).join(found, "id", "left").where("n > 1 or component is not null")
    least = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    verdicts = linked.join(least, "component", "left").select(*_SET, F.coalesce("smallest", "least").alias("component_id"), F.lit(True).alias("met"))
    verdicts = scratch.keep(verdicts, "verdicts")
    passing = ["members", "texts", "tried-stars", "links-stars", "components-stars", "families", "links-families", "tried-crossings", "links-crossings", "components-joined", "components"]
    scratch.drop("classes", *passing)
    out = signed.select("doc_id", *_SET).join(verdicts, _SET, "left")
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
