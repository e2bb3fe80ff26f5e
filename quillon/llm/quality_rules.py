"""Quality rules: statistics of every text, and a decision list learned from labelled ones.

The list is learned by sequential covering (after RIPPER, Cohen 1995): a rule is
a conjunction of thresholds on statistics, grown by FOIL gain on two thirds of
the labelled rows, pruned on the other third, and kept while it is precise
there; the rows it covers are set aside and the next rule is grown.  The list
comes out as one Spark ``CASE WHEN``, so that applying it is part of any plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels as K

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_digits", "n_echoes")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = (K.CLASSES == 2) & ~np.isin(np.arange(256), list(b".,"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
WINDOW = 8


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def text_counts(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of every text: words and their code points; characters of ``#*$%&|<>``; lines with a
    word, and those equal to an earlier one; words in 8-word windows found twice or more; other ASCII
    signs than ``.,``; A-Z; 0-9; words equal to the word before them."""
    words = K.Words(raw, offs)
    n = len(offs) - 1
    h = words.hashes(lower=False)
    inside = K.SPACED[raw]
    out = {"n_words": words.counts.astype(np.int64), "word_chars": _sums(inside & ((raw & 0xC0) != 0x80), offs), "n_symbols": _sums(_SYMBOLS[raw], offs)}

    line_cut = np.flatnonzero(raw == 10)
    begins = np.sort(np.concatenate([offs[:-1], line_cut + 1])) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(line_cut, offs)) + 1) if n else begins
    # a newline that ends a text opens an empty last line, which holds no word; it begins where the next text does
    ends = np.sort(np.concatenate([offs[1:], line_cut])) if n else begins
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, owner = begins[has], ends[has], owner[has]
    out["n_lines"] = np.bincount(owner, minlength=n).astype(np.int64)
    value = K.span_hashes(raw, begins, ends)
    order = np.lexsort((value, owner))
    same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=n).astype(np.int64)

    doc = words.documents()
    twice = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        at = np.flatnonzero(doc[: len(h) - WINDOW + 1] == doc[WINDOW - 1 :])
        keys = K.windows(h, WINDOW)[at] ^ K.mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        equal = keys[order][1:] == keys[order][:-1]
        dup = np.zeros(len(at), bool)
        dup[order[1:][equal]] = True
        dup[order[:-1][equal]] = True
        np.add.at(twice, at[dup], 1)
        np.add.at(twice, at[dup] + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(twice)[:-1] > 0, words.bounds)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["n_echoes"] = _sums(echo, words.bounds)
    for name, table in (("n_marks", _MARKS), ("n_upper", _UPPER), ("n_digits", _DIGIT)):
        out[name] = _sums(table[raw], offs)
    return {c: out[c] for c in COUNTS}


def text_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of STATS for every row of ``df``; a null text counts as empty; other columns are not read."""
    schema = K.arrow_schema(STATS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = text_counts(*K.buffers(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], schema=schema)

    return K.map_text(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, STATS)


#: What a condition may test: a name, and the ratio (numerator, denominator or None) of counts behind it.
MEASURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def measure(name: str) -> Column:
    """A measure as a Spark expression over STATS; a zero denominator gives 0."""
    top, below = MEASURES[name]
    if below is None:
        return F.col(top).cast("double")
    return F.when(F.col(below) == 0, F.lit(0.0)).otherwise(F.col(top) / F.col(below))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] >= self.value if self.above else x[self.measure] <= self.value

    def column(self) -> Column:
        return measure(self.measure) >= self.value if self.above else measure(self.measure) <= self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class RuleConfig:
    """sample: labelled rows used at most, those of the smallest id hash; the rest bound the list."""

    sample: int = 20_000
    max_rules: int = 16
    max_conditions: int = 4
    cuts: int = 48
    precision: float = 0.95
    least: int = 3
    seed: int = 11


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that meets any of them is rejected."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def column(self) -> Column:
        """1-based number of the first rule that a row of STATS meets, 0 if none."""
        made = None
        for i, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            made = F.when(test, F.lit(i)) if made is None else made.when(test, F.lit(i))
        return F.lit(0) if made is None else made.otherwise(F.lit(0))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            hit |= np.logical_and.reduce([c.holds(x) for c in rule])
        return hit

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, cfg: RuleConfig = RuleConfig()) -> DecisionList:
    """Sequential covering of the bad rows; no rows, or only one class, gives an empty list."""
    part = np.random.Generator(np.random.PCG64(cfg.seed)).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < cfg.max_rules and (left & bad).any() and (~bad).any():
        rule = _grow(x, bad, left & part, cfg)
        rule = _prune(x, bad, left & ~part, rule)
        if not rule:
            break
        hit = np.logical_and.reduce([c.holds(x) for c in rule])
        tested = hit & left & ~part
        good, n = (tested & bad).sum(), tested.sum()
        if (hit & left & bad).sum() < cfg.least or n == 0 or good < cfg.precision * n:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def _grow(x, bad, rows, cfg) -> tuple[Condition, ...]:
    rule, inside = [], rows.copy()
    while len(rule) < cfg.max_conditions and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        best, base = (0.0, None), np.log2(p0 / (p0 + n0))
        for name in MEASURES:
            v = x[name][inside]
            y = bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            seen = np.concatenate([[0], np.cumsum(y)])
            for cut in np.unique(np.quantile(x[name][inside & bad], np.linspace(0, 1, cfg.cuts))):
                lo, hi = np.searchsorted(v, cut, "left"), np.searchsorted(v, cut, "right")
                for above, p, n in ((True, seen[-1] - seen[lo], len(v) - lo), (False, seen[hi], hi)):
                    if p and (gain := p * (np.log2(p / n) - base)) > best[0] + 1e-12:
                        # midway to the next value outside, so that a near miss is not decided by one row
                        edge = (v[lo] + v[lo - 1]) / 2 if above and lo > 0 else (v[hi - 1] + v[hi]) / 2 if not above and hi < len(v) else cut
                        best = (gain, Condition(name, above, float(edge)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(x, bad, rows, rule) -> tuple[Condition, ...]:
    """The shortest prefix with the best (p - n) / (p + n) on the rows held back."""
    best, kept = -2.0, rule
    for k in range(1, len(rule) + 1):
        hit = np.logical_and.reduce([c.holds(x) for c in rule[:k]]) & rows
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p + n and (worth := (p - n) / (p + n)) > best:
            best, kept = worth, rule[:k]
    return kept


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """``(doc_id, quality)`` of the ``most`` labelled rows with the smallest id hashes; rows with nulls go."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_rules(documents: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> DecisionList:
    """Learn from the statistics of at most ``cfg.sample`` labelled rows, brought to the driver, one row an id (the least, where an id repeats)."""
    spark = documents.sparkSession
    chosen = spark.createDataFrame(labelled_sample(labels, cfg.sample).collect(), "doc_id long, quality int")
    near = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most cfg.sample ids
    one = text_statistics(near).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x")).select("doc_id", "x.*")
    rows = one.join(F.broadcast(chosen), "doc_id").toArrow()
    x = {c: rows.column(c).to_numpy().astype(float) for c in COUNTS}
    ratios = {m: x[t] if b is None else np.divide(x[t], x[b], out=np.zeros(len(x[t])), where=x[b] > 0) for m, (t, b) in MEASURES.items()}
    return learn(ratios, rows.column("quality").to_numpy() == 0, cfg)


def apply_rules(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """STATS of every row with ``rule`` (0: none), ``base_failed`` and ``kept``.

    A row fails the base with under 20 words, or if more than 30 of 100 words lie
    in repeated 8-word windows; null and empty texts do.  Repeated rows and ids
    are judged one by one.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = text_statistics(documents).withColumn("base_failed", failed).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
