"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Base kinds (leftmost, non-overlapping within a kind): assign, access and hex, as in PATTERNS.
The method adds spans of kind entropy: candidate strings are runs of one character class;
a window of WINDOW characters slides over each, its counts are updated by the character
that enters and the one that leaves, and windows whose entropy reaches the class's bound
are joined to spans. Candidates on the allow-list give none: plain words and numbers (a
secret mixes letters and digits), strings that a rule of ALLOWED fits, and any given by
the caller. Base spans are never suppressed.

Positions count code points, ends are exclusive. Edge cases: null and empty texts have no
spans; rows that repeat are scanned each; an empty table gives none. Work and memory of a
text, however long, are linear in it. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns, and the least characters of an assigned value. A short
#: assignment is dropped, but what it spans is still used up.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of AKIA[A-Z0-9]+ those of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")  # of [0-9a-f]+ those of 16 characters or more
LEAST_VALUE = 12
#: Class name: pattern of a candidate, least entropy of a window in bits per character.
WINDOW = 20
CLASSES = {
    "hex": (re.compile(r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])"), 3.0),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7),
}
ALLOWED = (
    re.compile(r"[A-Za-z+/_=-]*"),
    re.compile(r"[0-9+/_=-]*"),
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    re.compile(r"(?:[a-z]+[-_/])*[a-z]+[-_/]?[0-9]{1,8}"),
    re.compile(r".*(?:0123456789|abcdefghij|ABCDEFGHIJ).*"),
)
_TERM = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def entropy_spans(text: str, start: int, bound: float) -> list[tuple[int, int]]:
    """Joined windows of text, as (start + a, start + b), whose entropy is at least bound."""
    count: dict[str, int] = {}
    total, out = 0.0, []
    base = log2(WINDOW)
    for i, c in enumerate(text):
        n = count.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        count[c] = n + 1
        if i >= WINDOW:
            gone = text[i - WINDOW]
            n = count[gone]
            total += _TERM[n - 1] - _TERM[n]
            count[gone] = n - 1
        if i >= WINDOW - 1 and base - total / WINDOW >= bound - 1e-9:
            a, b = start + i - WINDOW + 1, start + i + 1
            if out and out[-1][1] >= a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def scan(text: str | None, allowed: tuple[re.Pattern, ...] = ()) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans, sorted."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), kind, m.end()) for kind, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text)]
    seen = set()
    for pattern, bound in CLASSES.values():
        for m in pattern.finditer(text):
            word = m.group()
            if any(a.fullmatch(word) for a in (*ALLOWED, *allowed)):
                continue
            for a, b in entropy_spans(word, m.start(), bound):
                if (a, b) not in seen:
                    seen.add((a, b))
                    found.append((a, 3, b))
    return sorted(found)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end), by start, then kind as in KINDS.
    allowed: more patterns for the allow-list. No shuffle."""
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = tuple(map(re.compile, allowed))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in scan(t.as_py(), more)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found, schema)], ["doc_id", "spans"])

    return docs.select(key, text).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def scan_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access and n_hex (base spans of each kind), base_sha256 (of the base
    spans, written as in spans) and spans (all, as kind:start:end joined by commas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = tuple(map(re.compile, allowed))
        for b in batches:
            found = [scan(t.as_py(), more) for t in b.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(3)]
            sums = [digest(named([s for s in x if s[1] < 3])) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *counts, pa.array(sums, pa.string()), pa.array(map(named, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(key, text).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
