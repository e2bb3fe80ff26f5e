"""License scan: a positional index of rare licence words, with key phrases to verify.

Templates are licence notices and the paragraphs of whole licences.  Their words have inverse document
frequencies taken over the whole corpus.  For every template that can stand in a
file, by the words the file holds, its highest-IDF words are looked up; every
posting of such a word in the template gives a relative position (place in the file
less place in the template), and where enough of them agree on a position, the
passage is taken to stand there.  So many words are looked up that no passage with
its share of words in place can miss that.  It counts once its mandatory phrases are
found at the same alignment.  Base phrases are found by their own words standing
consecutively.

Words: A-Z lowered, then maximal runs of ASCII letters, digits and anything
beyond ASCII.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K
from quillon.llm.license_texts import NOTICES, TEXTS

#: Fixed by the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, passage, phrases that must stand in the aligned passage).
TEMPLATES = NOTICES + TEXTS


@dataclass(frozen=True)
class LicenseConfig:
    """agree: looked-up words that must agree on an alignment; share: least share of a template's words at it."""

    agree: int = 2
    share: float = 0.6

    def rare(self, length: int) -> int:
        """Words of a template to look up: all but these may be out of place, and ``agree`` of these are then in place."""
        return length - math.ceil(self.share * length - 1e-9) + self.agree


def hashes(text: str) -> list[int]:
    """Hashes of a text's words, as the corpus's are."""
    return K.Words(*K.buffers(pa.array([text])), table=K.ALNUM).hashes().tolist()


class Index:
    """Vocabulary, positional postings and mandatory phrases of the templates."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, hashes(text), [hashes(p) for p in phrases]) for label, text, phrases in templates]
        self.base = [(label, np.array(hashes(phrase), np.uint64)) for phrase, label in BASE]
        self.vocabulary = np.unique(np.array([w for _, ws, _ in self.templates for w in ws], np.uint64))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ws, _) in enumerate(self.templates):
            for q, w in enumerate(ws):
                self.postings.setdefault(w, []).append((t, q))
        #: Vocabulary numbers of every template's words, and of those in its mandatory phrases.
        self.numbers = [np.searchsorted(self.vocabulary, np.array(ws, np.uint64)) for _, ws, _ in self.templates]
        self.needed = [np.searchsorted(self.vocabulary, np.unique(np.array([w for p in phrases for w in p], np.uint64))) for _, _, phrases in self.templates]
        #: For every template, the places of each mandatory phrase in it.
        self.keys = [[next(q for q in range(len(ws)) if ws[q : q + len(p)] == p) for p in phrases] for _, ws, phrases in self.templates]


def document_frequencies(texts: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """How many texts hold each vocabulary word, and how many texts there are; one row a task and word is shuffled."""
    vocabulary = index.vocabulary
    K.small_batches(texts.sparkSession)

    def count(batches):
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for whole in batches:
            for batch in K.chunks(whole):
                words = K.Words(*K.buffers(batch.column(1)), table=K.ALNUM)
                at, doc = _hits(words, vocabulary)
                df += np.bincount(np.unique(doc * len(vocabulary) + at[1]) % len(vocabulary), minlength=len(vocabulary))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], ["word", "n"])

    got = texts.mapInArrow(K.tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in got:
        out[r.word + 1] = r.n
    return out[1:], int(out[0])


def _hits(words: K.Words, vocabulary: np.ndarray):
    """((place in the chunk, vocabulary number) of every template word, its text)."""
    h = words.hashes()
    number = np.searchsorted(vocabulary, h)
    number[number == len(vocabulary)] = 0
    at = np.flatnonzero(vocabulary[number] == h)
    return (at, number[at]), np.searchsorted(words.bounds, at, "right") - 1


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(df: DataFrame, cfg: LicenseConfig = LicenseConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCANNED for every row of ``df``.

    score: the largest share of a template's words found at a verified alignment, 0
    without one, 1 for a base phrase.  A null text is empty: no words, no labels,
    null places.  Repeated rows are scanned one by one; no rows give no rows.
    """
    index, schema = Index(), K.arrow_schema(SCANNED)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen, n = document_frequencies(rows, index)
    idf = np.log((n + 1) / (seen + 0.5))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = K.Words(*K.buffers(batch.column(1)), table=K.ALNUM)
        rows = batch.num_rows
        (at, number), doc = _hits(words, index.vocabulary)
        h, begin = words.hashes(), words.bounds[:-1]
        n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        base_labels: list[set] = [set() for _ in range(rows)]
        for label, phrase in index.base:
            if len(h) < len(phrase):
                continue
            ok = np.logical_and.reduce([h[i : len(h) - len(phrase) + 1 + i] == w for i, w in enumerate(phrase)])
            place = np.flatnonzero(ok)
            owner = np.searchsorted(words.bounds, place, "right") - 1
            inside = place + len(phrase) <= words.bounds[owner + 1]
            place, owner = place[inside], owner[inside]
            np.add.at(n_base, owner, 1)
            np.minimum.at(first, owner, place - begin[owner])
            np.maximum.at(last, owner, place - begin[owner])
            for d in set(owner.tolist()):
                base_labels[d].add(label)
        labels, score = [set(x) for x in base_labels], (n_base > 0).astype(float)
        cuts = np.searchsorted(doc, np.arange(rows + 1))
        for d in np.flatnonzero(np.diff(cuts) >= cfg.agree):
            found = _aligned(h[words.bounds[d] : words.bounds[d + 1]], at[cuts[d] : cuts[d + 1]] - begin[d], number[cuts[d] : cuts[d + 1]], idf, index, cfg)
            for t, worth in found.items():
                labels[d].add(index.templates[t][0])
                score[d] = max(score[d], worth)
        join = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
        none = n_base == 0
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts.astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), join(base_labels), join(labels), pa.array(score)], schema=schema
        )

    return K.map_text(rows, work, SCANNED)


def _aligned(h: np.ndarray, at: np.ndarray, number: np.ndarray, idf: np.ndarray, index: Index, cfg: LicenseConfig) -> dict[int, float]:
    """Templates that stand in one file, with the share of their words found."""
    held = np.zeros(len(index.vocabulary), bool)
    held[number] = True
    out: dict[int, float] = {}
    for t, (_, ws, phrases) in enumerate(index.templates):
        own = index.numbers[t]
        if not held[index.needed[t]].all() or held[own].sum() / len(ws) < cfg.share:
            continue
        rare = np.unique(own[held[own]])
        rare = rare[np.argsort(-idf[rare], kind="stable")][: cfg.rare(len(ws))]
        # a word stands at one place once, so an alignment's votes are of different words
        votes = [at[number == w] - q for w in rare for t_, q in index.postings[int(index.vocabulary[w])] if t_ == t]
        base, n = np.unique(np.concatenate(votes), return_counts=True)
        base = base[n >= cfg.agree]
        for p, q in zip(phrases, index.keys[t]):
            base = base[(base + q >= 0) & (base + q + len(p) <= len(h))]
            for i, w in enumerate(p):
                base = base[h[base + q + i] == np.uint64(w)]
        for b in base.tolist():
            lo, hi = max(0, b), min(len(h), b + len(ws))
            share = float((h[lo:hi] == np.array(ws[lo - b : hi - b], np.uint64)).sum()) / len(ws)
            if share >= cfg.share and share > out.get(t, 0):
                out[t] = share
    return out
