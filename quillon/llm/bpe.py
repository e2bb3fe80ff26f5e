"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols stand in a linked list; the leaf of place i holds the rank of
the pair that begins there.  The tree's root is then the lowest rank at the
leftmost place, each merge changes three leaves and their paths, and a word is
done when the root holds no rank.  Many words of about one length are worked on
together, one tree a row of an array.  A task keeps the encodings of words it has
met, up to a bound.

The scheme is that of a tokenizer file of the ``tokenizers`` library with a BPE
model that has word ends and byte-level symbols, lower case after NFC, and the
splitting pattern below.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K

#: Fixed by the tokenizer file: its splitting pattern; white space is Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+", regex.V0)
_NO_RANK = np.int64(1) << np.int64(62)


@functools.cache
def _unsure() -> re.Pattern:
    """Code points that this Python's Unicode has not assigned: libraries of other versions class them in other ways."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    spans, begin = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            spans.append(f"{re.escape(chr(begin))}-{re.escape(chr(a))}")
            begin = b
    return re.compile(f"[{''.join(spans)}]")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@dataclass(frozen=True)
class BPEConfig:
    """cache: words whose encoding a task keeps; batch: words encoded together."""

    cache: int = 200_000
    batch: int = 8192


class WordBPE:
    """Encoder and decoder of one tokenizer file's content."""

    def __init__(self, content: bytes, cfg: BPEConfig = BPEConfig()):
        made = json.loads(content)
        model, self.cfg = made["model"], cfg
        kinds = [n["type"] for n in made["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or made.get("decoder") is not None:
            raise ValueError("not a tokenizer file of the kind this encoder is for")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        signs = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in signs], np.int64)
        self.last = np.array([vocabulary[s + end] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # of a pair listed twice the later rank counts, as in a map
        order = np.lexsort((np.arange(len(key)), key))
        late = np.ones(len(order), bool)
        late[:-1] = key[order][1:] != key[order][:-1]
        self.keys, self.ranks, self.into = key[order][late], order[late].astype(np.int64), into
        self.bytes_of = {s: b for b, s in enumerate(signs)}
        self.content, self.splitter = content, None
        self.cache: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; beyond any rank where it cannot merge or a side is missing (-1)."""
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word (its UTF-8, not empty)."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            step = max(1, min(self.cfg.batch, (1 << 20) // int(w)))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                for j, ids in zip(part.tolist(), self._encode([words[j] for j in part], int(w))):
                    out[j] = ids
        return out

    def _encode(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n, bits = len(words), np.int64(width.bit_length())
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        inside = place < size[:, None]
        # one column more: the place behind a word, and before its first, has no symbol
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width] = np.where(inside, self.inner[raw], -1)
        rows = np.arange(n)
        symbol[rows, size - 1] = self.last[raw[rows, size - 1]]
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        after[rows, size - 1] = width
        before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
        alive = inside.copy()
        tree = np.full((n, 2 * width), _NO_RANK, np.int64)
        rank = self._rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < _NO_RANK, (rank << bits) | place, _NO_RANK)
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        active = np.flatnonzero(tree[:, 1] < _NO_RANK)
        mask = (np.int64(1) << bits) - 1
        while len(active):
            root = tree[active, 1]
            at, best = root & mask, root >> bits
            gone = after[active, at]
            symbol[active, at] = self.into[best]
            beyond = after[active, gone]
            after[active, at] = beyond
            before[active, beyond] = at
            alive[active, gone] = False
            front = before[active, at]
            fresh = self._rank(symbol[active, at], np.where(beyond < width, symbol[active, beyond], -1))
            back = self._rank(np.where(front < width, symbol[active, front], -1), symbol[active, at])
            self._point(tree, active, gone, np.full(len(active), _NO_RANK), width)
            self._point(tree, active, at, np.where(fresh < _NO_RANK, (fresh << bits) | at, _NO_RANK), width)
            has = front < width
            self._point(tree, active[has], front[has], np.where(back < _NO_RANK, (back << bits) | front, _NO_RANK)[has], width)
            active = active[tree[active, 1] < _NO_RANK]
        ids = symbol[:, :width][alive]
        return np.split(ids.astype("<u4"), np.cumsum(alive.sum(axis=1))[:-1])

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> None:
        """Set one leaf in each row and mend the path to the root."""
        node = place + width
        tree[rows, node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    @staticmethod
    def normalize(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case is by character here: no final sigma
        return text.lower()

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        A text with code points that Unicode versions class differently is normalized
        and split (not merged) by the library, so that its version decides.
        """
        if text.isascii() or _is_latin(text) or not _unsure().search(text):
            return _SPLIT.findall(self.normalize(text))
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_str(self.content.decode())
        plain = self.splitter.normalizer.normalize_str(text)
        return [bytes(self.bytes_of[c] for c in w).decode() for w, _ in self.splitter.pre_tokenizer.pre_tokenize_str(plain)]

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text in turn, and the ids of special tokens that stand in it."""
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.words(text[at:])

    def learn(self, words: set) -> None:
        """Put the encodings of new words in the cache."""
        fresh = [w for w in words if w not in self.cache]
        if len(self.cache) + len(fresh) > self.cfg.cache:
            self.cache.clear()
            self.decoded.clear()
            fresh = list(words)
        plain = [w for w in fresh if isinstance(w, str)]
        for w, ids in zip(plain, self.encode_words([w.encode() for w in plain])):
            self.cache[w] = ids.tobytes()
            self.decoded[w] = self.decode(ids)
        for i in fresh:
            if not isinstance(i, str):
                self.cache[i], self.decoded[i] = np.array([i], "<u4").tobytes(), self.decode([i])

    def decode(self, ids) -> str:
        """Tokens joined by blanks, special tokens among them; ids without a token give nothing."""
        return " ".join([self.tokens[int(i)] for i in ids if int(i) in self.tokens])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(little-endian ids, decoded text) of every text."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        ids, words = self.cache, self.decoded
        return [(b"".join([ids[w] for w in part]), " ".join([words[w] for w in part])) for part in split]


_ENCODERS: dict[str, WordBPE] = {}


def encoder(content: bytes, cfg: BPEConfig = BPEConfig()) -> WordBPE:
    """The process's encoder of this file: made once, and its cache kept over tasks."""
    key = hashlib.sha256(content).hexdigest() + repr(cfg)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordBPE(content, cfg)
    return _ENCODERS[key]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str, cfg: BPEConfig = BPEConfig(), doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """ENCODED for every row of ``df``; ``with_ids`` adds ``ids array<long>`` and ``decoded string``.

    path: a tokenizer file on the driver; its bytes (below 2 MB for the public files)
    are sent to the tasks.  A null text is empty and gives no tokens.  Repeated rows
    and null ids are encoded like any other; no rows give no rows.
    """
    content = df.sparkSession.sparkContext.broadcast(_read(path))
    ddl = ENCODED + (", ids array<long>, decoded string" if with_ids else "")
    schema = K.arrow_schema(ddl)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = encoder(content.value, cfg).encode_batch([t or "" for t in batch.column(1).to_pylist()])
        columns = [
            batch.column(0),
            pa.array([len(ids) // 4 for ids, _ in made], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in made], pa.string()),
            pa.array([hashlib.sha256(out.encode()).hexdigest() for _, out in made], pa.string()),
        ]
        if with_ids:
            columns += [pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for ids, _ in made], pa.list_(pa.int64())), pa.array([out for _, out in made], pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return K.map_text(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, ddl, most=K.CHUNK_BYTES // 2)
