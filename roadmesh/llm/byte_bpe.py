"""Byte-level BPE encoding and decoding by a tree reduction over bytes.

Encodings of byte strings form a monoid: ``join(code(x), code(y)) = code(x + y)``. So a piece
(a match of the split pattern) is halved down to single bytes and its halves' codes are joined
on the way up. A join re-encodes a window of tokens around the seam, at first one token on
each side, and widens it on a side until the tokens beyond it provably stay:

A sequence of tokens is the code of its bytes if and only if each two neighbours a, b are
stable: the code of a's and b's bytes is (a, b). For merges go by (rank, place). As long as
none crosses a seam, those on its two sides don't see each other, and those within the tokens
a and b that end up at the seam depend on no byte outside them. The pair that meets at the
seam is therefore the same at every step in the whole string as in a + b alone: a merge
crosses the seam in one if and only if it does in the other. This holds for any table of
ranks. Within the window the code is computed; left and right of it neighbours were stable
before. So two checks, one for each end of the window, prove a join.

Decoding concatenates: blocks of tokens first, then the blocks.

A piece that is a token as it stands is that token, as in the library. A text is first cut
before each blank with no other white space beside it, where pieces always end; the codes of
these chunks, of strings of at most five bytes and of pairs of tokens are remembered in
bounded numbers.

Edge cases: a null or empty text has no ids and decodes to no bytes. Repeated rows are coded
each, an empty table gives none. A very long text is coded whole, in memory linear in it, and
a very long piece in n log n time. Extra columns stay, whatever their names: if one is named
like the ids, the ids' column gets underscores before its name. Ids that the table lacks
raise a KeyError.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import free_name, lean

#: The split pattern of the public rank files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks, short strings and pairs that a worker remembers before it starts anew; about 250 bytes each.
CACHED_CHUNKS, CACHED_PARTS, CACHED_PAIRS = 400_000, 200_000, 250_000
_BLOCK = 4096
_PART = 5
_ROWS = 256
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s |^ | \s| $")
Code = tuple[int, ...]


class ByteBPE:
    """A table of ranks: bytes of a token -> its id."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.octets = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.octets}
        self.split = regex.compile(PATTERN).findall
        self.chunks: dict[str, Code] = {}
        self.parts: dict[bytes, Code] = {}
        self.pairs: dict[tuple[int, int], Code] = {}

    def merge(self, data: bytes) -> Code:
        """The code of data by its definition, least rank and leftmost place first: for windows."""
        if len(data) <= 24:
            return self._merge_short(data)
        ranks, n = self.ranks, len(data)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # tokens by their first byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= stop or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := left[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[data[i : end[i]]] for i in range(n) if alive[i])

    def _merge_short(self, data: bytes) -> Code:
        get, none = self.ranks.get, 2**62
        cut = list(range(len(data) + 1))
        rank = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(data[cut[i] : cut[i + 2]], none)
            if i:
                rank[i - 1] = get(data[cut[i - 1] : cut[i + 1]], none)
        return tuple([self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])])

    def seam(self, a: int, b: int) -> Code:
        """The code of the bytes of two tokens; (a, b) if they are stable side by side."""
        code = self.pairs.get((a, b))
        if code is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            code = self.pairs[a, b] = self.merge(self.octets[a] + self.octets[b])
        return code

    def join(self, x: Code, y: Code) -> Code:
        """The code of the bytes of two codes."""
        if not x or not y:
            return x or y
        seam = x[-1], y[0]
        window, i, j = self.pairs.get(seam) or self.seam(*seam), 1, 1
        if window == seam:
            return x + y
        while True:
            left = i == len(x) or self.seam(x[-i - 1], window[0]) == (x[-i - 1], window[0])
            right = j == len(y) or self.seam(window[-1], y[j]) == (window[-1], y[j])
            if left and right:
                return x[: len(x) - i] + window + y[j:]
            i, j = i if left else min(2 * i, len(x)), j if right else min(2 * j, len(y))
            window = self.merge(self.decode(x[len(x) - i :] + y[:j]))

    def reduce(self, data: bytes) -> Code:
        """The code of data: its halves' codes, joined."""
        n = len(data)
        if n > _PART:
            return self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
        code = self.parts.get(data)
        if code is None:
            if len(self.parts) >= CACHED_PARTS:
                self.parts.clear()
            code = (self.ranks[data],) if n == 1 else self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
            self.parts[data] = code
        return code

    def piece(self, text: str) -> Code:
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.reduce(data)

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text."""
        out, known = [], self.chunks
        for text in texts:
            parts = _chunks(text or "")
            for p in set(parts).difference(known):
                cut = self.split(p)
                known[p] = self.piece(p) if len(cut) == 1 else tuple(chain.from_iterable(map(self.piece, cut)))
            out.append(list(chain.from_iterable(map(known.__getitem__, parts))))
            if len(known) > CACHED_CHUNKS:
                known.clear()
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids."""
        if len(ids) <= _BLOCK:
            return b"".join(map(self.octets.__getitem__, ids))
        return b"".join(self.decode(ids[k : k + _BLOCK]) for k in range(0, len(ids), _BLOCK))


def _chunks(text: str) -> list[str]:
    """text, cut before blanks that have no other white space beside them."""
    if _ODD.search(text):
        return _CUT.split(text)
    first, *more = text.split(" ")
    return [first, *(" " + w for w in more)]


@functools.lru_cache(maxsize=2)
def load(ranks_path: str) -> ByteBPE:
    """The ranks of a file with a token in base64 and its rank on each line."""
    with open(ranks_path, "rb") as lines:
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of ids for each text and, if named, one with the bytes decoded from
    them; a name that docs has already gets underscores before it. ranks_path must be readable
    on every executor. No shuffle; rows stay where they are read."""
    ids = free_name(docs.columns, ids)
    decoded = decoded and free_name([*docs.columns, ids], decoded)
    place = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{ids}` array<int>", *([f"`{decoded}` binary"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = bpe.encode(part.column(place).to_pylist())
                cols = [*part.columns, pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(lean(run), schema)


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the bytes of each array of ids (null: null)."""
    decoded, place = free_name(docs.columns, decoded), docs.columns.index(ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{decoded}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = [None if x is None else bpe.decode(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, decoded])

    return docs.mapInArrow(lean(run), schema)


def encoding_digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(map(len, found), pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(bpe.decimal.__getitem__, x)).encode()).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
