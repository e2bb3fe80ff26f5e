"""Secret scan over an incremental ledger of blobs.

A blob is a text by its SHA-256; many paths (documents, versions) may hold one
blob.  The ledger has a row for each blob and rule version that was scanned,
with its findings.  A run hashes all texts, takes the blobs that the ledger has
not seen under the present rules, scans each of them once, and joins the findings
of ledger and run back to every path.

Rules are regular expressions over whole texts; a span is ``kind:start:end`` in
code points.  Texts are searched one by one only where a cheap look at the
batch's bytes says that a rule may match.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from quillon.llm import kernels as K
from quillon.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """least: characters of the span, or of the group named; hints: lower-case bytes of which one is in any match, none: a run of 24 hex digits."""

    kind: str
    pattern: str
    hints: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


#: Fixed by the contract: kinds, patterns and least lengths of the base.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (b"password", b"passwd", b"secret", b"token", b"api"), 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", (b"akia",), 0, 20),
    Rule("hex", r"[0-9a-f]+", (), 0, 24),
)
#: Each begins at one place of a run of its letters only and gives nothing back, so that any text is scanned in time linear in its length.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", (b"private key-----",)),
    Rule("bearer", r"\bBearer [A-Za-z0-9._~+/-]{20,}+=*", (b"bearer ",)),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]+", (b"eyj",)),
    Rule("code_host", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"glpat-")),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", (b"xox",)),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]{1,64}+:[^\s/:@]{1,64}+@", (b"://",)),
)
RULES = BASE + ADDED
#: Changes whenever a rule or the look (2: hex runs end with their text) does, so that older ledger rows are not taken for the present rules.
VERSION = hashlib.sha256(repr((RULES, 2)).encode()).hexdigest()[:16]
_COMPILED = [(r, re.compile(r.pattern, r.flags)) for r in RULES]
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

LEDGER = "blob string, rules string, kind string, at long, until long"


def spans(text: str, rules=_COMPILED) -> list[tuple[str, int, int]]:
    """All matches, leftmost and without overlap within a kind, by start and then by the order of the rules."""
    found = []
    for n, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if rule.least <= m.end(rule.group) - m.start(rule.group):
                found.append((m.start(), n, m.end()))
    return [(rules[n][0].kind, a, b) for a, n, b in sorted(found)]


def _suspects(raw: np.ndarray, offs: np.ndarray) -> dict[int, list]:
    """For each text that may match, the rules to run."""
    low, out = K.LOWER[raw].tobytes(), {}
    for rule, pattern in _COMPILED:
        if rule.hints:
            places = []
            for hint in rule.hints:
                at = low.find(hint)
                while at >= 0:
                    d = int(np.searchsorted(offs, at, "right")) - 1
                    places.append(d)
                    at = low.find(hint, int(offs[d + 1]))
            texts = set(places)
        else:
            runs = K.Words(raw, offs, _HEX)  # no run goes over a text's end
            texts = set(runs.documents()[runs.ends - runs.starts >= rule.least].tolist())
        for d in texts:
            out.setdefault(d, []).append((rule, pattern))
    return out


def _look(rows: DataFrame) -> DataFrame:
    """(doc_id, blob, text) with the text only where a rule may match."""
    ddl = "doc_id long, blob string, text string"
    schema = K.arrow_schema(ddl)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        suspects = np.ones(batch.num_rows, bool)
        suspects[list(_suspects(*K.buffers(batch.column(2))))] = False
        at = pa.array(np.where(suspects, -1, np.arange(batch.num_rows)), mask=suspects)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).take(at).cast(pa.string())], schema=schema)

    return K.map_text(rows, work, ddl)


def _scan_blobs(blobs: DataFrame) -> DataFrame:
    """LEDGER rows of (blob, text): one for each finding, and one with a null kind for a clean blob."""
    schema = K.arrow_schema(LEDGER)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = spans(text) if text is not None else []
            rows += [(blob, VERSION, *x) for x in got] or [(blob, VERSION, None, None, None)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return K.map_text(blobs.select("blob", "text"), work, LEDGER)


def update_ledger(df: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``(paths, ledger)``: (doc_id, blob) of every row, and the ledger with all blobs of ``df`` in it.

    Only blobs without a row of the present rule version are scanned, each once.
    The pass that hashes a text also looks at its bytes for the rules' fixed parts,
    at about the cost of the hash, and only texts that have one move on; so no other
    text is shuffled, and a text without one is entered as clean.  A null text is
    the empty blob.  Copies, nulls in the id and repeated rows are paths of one blob.
    Both results are scans of written tables.
    """
    scratch = scratch or Scratch(df.sparkSession, "secrets")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    paths = scratch.keep(_look(rows.select("doc_id", F.sha2("text", 256).alias("blob"), "text")), "paths")
    unseen = paths.select("blob", F.col("text").isNotNull().alias("suspect")).groupBy("blob").agg(F.max("suspect").alias("suspect"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == VERSION).select("blob").distinct(), "blob", "left_anti")
    bodies = paths.where("text is not null").groupBy("blob").agg(F.min_by("text", F.coalesce("doc_id", F.lit(0))).alias("text"))
    fresh = scratch.keep(_scan_blobs(unseen.join(bodies, "blob", "left")), "findings")
    known = fresh if ledger is None else ledger.select(fresh.columns).unionByName(fresh)
    return paths.select("doc_id", "blob"), known


def findings_by_path(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(doc_id, blob, spans)`` of every path; spans is a sorted array of (at, rank, until, kind)."""
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in RULES]), F.col("kind")).cast("int")
    known = ledger.where((F.col("rules") == VERSION) & F.col("kind").isNotNull())
    found = known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("at", rank.alias("rank"), "until", "kind"))).alias("spans"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<at:bigint,rank:int,until:bigint,kind:string>>")).alias("spans"))


def _marked(mark: str):
    """A column function (text, starts, ends by start) -> the text with the mark for each run of overlapping spans; null for a null text."""

    @F.pandas_udf(StringType())
    def of(text: pd.Series, at: pd.Series, until: pd.Series) -> pd.Series:
        out = []
        for t, starts, ends in zip(text, at, until):
            parts, done = [], 0
            for a, b in zip(starts, ends) if t is not None else ():
                if a >= done:
                    parts += [t[done:a], mark]
                done = max(done, b)
            out.append(None if t is None else "".join([*parts, t[done:]]))
        return pd.Series(out, dtype=object)

    return of


def redact(df: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret's span replaced by ``mark``; overlapping spans are replaced as one.

    All columns are kept, in their order; a null text stays null.  Findings meet
    the rows by the text's hash, so copies and repeated ids are all redacted.  Only
    texts with findings leave the JVM, and each is rebuilt in one pass, however long it is.
    """
    K.small_batches(df.sparkSession)
    _, known = update_ledger(df, ledger, doc_id, text)
    known = known.where((F.col("rules") == VERSION) & F.col("kind").isNotNull())
    found = known.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.collect_list(F.struct("at", "until"))).alias("__spans"))
    # the row travels as one column, so no name of it can clash with the finding's
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    body, has = F.col(f"__row.`{text}`"), F.col("__spans").isNotNull()
    rows = whole.withColumn("__blob", F.sha2(body, 256)).join(found, "__blob", "left")
    made = _marked(mark)(F.when(has, body.cast("string")), F.col("__spans.at"), F.col("__spans.until"))
    rows = rows.withColumn("__clean", F.when(has, made).otherwise(body))
    return rows.select(*[F.col("__clean" if c == text else f"__row.`{c}`").alias(c) for c in df.columns])
