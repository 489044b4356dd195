"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut before each run of blanks (no piece of the vocabulary holds a blank after
another character, so no merge crosses a cut; that is checked when a model is loaded).
The distinct words of a batch become one flat array of symbol ids. A round finds each
word's least pair rank with a segmented minimum, merges its leftmost non-overlapping
occurrences in all words at once and compacts the array, until no pair is left.

Merging all occurrences at once equals the library's one-at-a-time order as long as no
new pair ranks before (or with) the pair just merged. Words where one does are flagged in
the round that shows it and, like words of more than ``LONG`` symbols, merged one pair at
a time with a heap; so the result is exact for every text.

Edge cases: a null or empty text has no ids and decodes to the empty text; characters
that the vocabulary lacks become byte pieces; ids that form no valid UTF-8 decode to
U+FFFD for each bad byte. Repeated rows are coded each, an empty table gives none. A very
long text is coded whole, in memory linear in it. Extra columns stay, whatever their names:
if one is named like the ids, the ids' column gets underscores before its name.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, lean

BLANK = "▁"
LONG = 400
#: Words that a task remembers before it starts anew; about 300 bytes each.
CACHED_WORDS = 250_000
_NONE = np.int32(2**31 - 1)


class PieceBPE:
    """The vocabulary of one model and its pair table."""

    def __init__(self, model_path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = n = lib.vocab_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        names = [lib.id_to_piece(i) for i in range(n)]
        self.index = {names[i]: i for i in range(n) if not special[i]}
        if any(BLANK in p.lstrip(BLANK) for p in self.index):
            raise ValueError("a piece holds a blank after another character: words can't be cut apart")
        self.byte0 = names.index("<0x00>")
        scores = {i: lib.get_score(i) for i in self.index.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # characters that occur in pieces only: symbols that may merge, but end as bytes
        self.symbol, self.extra = dict(self.index), []
        for c in sorted({c for p in self.index for c in p} - self.index.keys()):
            self.symbol[c] = n + len(self.extra)
            self.extra.append(c)
        self.unknown = n + len(self.extra)
        pairs = {}
        for piece, i in self.index.items():
            for k in range(1, len(piece)):
                a, b = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[scores[i]], i)
        self.pairs = pairs
        found = sorted((a << 20 | b, *v) for (a, b), v in pairs.items())
        self.keys = np.array([x[0] for x in found] + [2**62], np.int64)
        self.ranks = np.array([x[1] for x in found] + [_NONE], np.int32)
        self.merged = np.array([x[2] for x in found] + [0], np.int32)
        self.hashed()
        chars = {ord(c): i for c, i in self.symbol.items() if len(c) == 1}
        self.char_ids = np.full(max(chars) + 2, self.unknown, np.int32)
        self.char_ids[list(chars)] = list(chars.values())
        self.decimal = [str(i) for i in range(n)]
        self.numbers = list(range(self.unknown + 1))  # one object per id, however often words hold it
        self.octets = [names[i].replace(BLANK, " ").encode() if i in scores else b"" for i in range(n)]
        for i in range(n):
            if lib.is_byte(i):
                self.octets[i] = bytes([int(names[i][3:5], 16)])
            elif lib.is_unknown(i):
                self.octets[i] = " ⁇ ".encode()
        self.opens = [i in scores and names[i].startswith(BLANK) for i in range(n)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def hashed(self) -> None:
        """Two tables of places in the pair table, by two hashes; a pair is in one of them."""
        none, keys = len(self.keys) - 1, self.keys[:-1].astype(np.uint64)
        self.slots = []
        left = np.arange(none)
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            slot = (keys[left] * np.uint64(mult) >> np.uint64(45)).astype(np.int64)
            table = np.full(1 << 19, none, np.int32)
            table[slot] = left
            self.slots.append((np.uint64(mult), table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError(f"{len(left)} pairs fit none of the tables")

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs (a, b) in the pair table; the last place is 'no pair'."""
        key = a.astype(np.int64) << 20 | b
        wide = key.view(np.uint64)
        (mult, table), *more = self.slots
        at = table[wide * mult >> np.uint64(45)]
        open_ = np.flatnonzero((self.keys[at] != key) & (at != len(self.keys) - 1))
        for mult, table in more:
            if len(open_):
                at[open_] = table[wide[open_] * mult >> np.uint64(45)]
                open_ = open_[(self.keys[at[open_]] != key[open_]) & (at[open_] != len(self.keys) - 1)]
        at[open_] = len(self.keys) - 1
        return at

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        out: list = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.merge_one(w)
            else:
                short.append(k)
        if not short:
            return out
        lengths = np.array([len(words[k]) for k in short])
        points = np.frombuffer("".join(words[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char_ids[np.minimum(points, len(self.char_ids) - 1)]
        char = np.arange(len(sym), dtype=np.int32)  # where a symbol starts: an unknown one is the character there
        word = np.repeat(np.arange(len(short), dtype=np.int32), lengths)
        bounds = np.r_[0, np.cumsum(lengths)]
        strict = np.zeros(len(short), bool)
        place = np.full(len(sym), len(self.keys) - 1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        place[inner] = self.lookup(sym[inner], sym[inner + 1])
        final = np.full(len(sym), -1, np.int32)
        while len(sym):
            rank = self.ranks[place]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            live = least != _NONE
            if not live.all():  # words without a pair are finished
                ended = ~live
                final[char[ended]] = sym[ended]
                sym, char, word, place, rank, least = (x[live] for x in (sym, char, word, place, rank, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            start = np.r_[True, np.diff(hit) != 1]  # in a run of touching pairs every other one merges
            offset = np.arange(len(hit)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            at = hit[offset & 1 == 0]
            new, bar = self.merged[place[at]], rank[at]
            # the pair with the next symbol as it stands while the word is merged from the left
            has = np.flatnonzero((at + 2 < len(sym)) & (word[np.minimum(at + 2, len(sym) - 1)] == word[at]))
            early = self.ranks[self.lookup(new[has], sym[at[has] + 2])] <= bar[has]
            strict[word[at[has[early]]]] = True
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, char, word, place = (x[keep] for x in (sym, char, word, place))
            for left, mine in ((moved - 1, moved), (moved, moved)):
                ok = (left >= 0) & (left + 1 < len(sym))
                ok &= word[np.where(ok, left, 0)] == word[np.where(ok, left + 1, 0)]
                place[left[(left >= 0) & ~ok & (left == mine)]] = len(self.keys) - 1
                place[left[ok]] = self.lookup(sym[left[ok]], sym[left[ok] + 1])
                early = self.ranks[place[left[ok]]] <= bar[ok]
                strict[word[mine[ok][early]]] = True
            if strict.any():
                keep = ~strict[word]
                sym, char, word, place = (x[keep] for x in (sym, char, word, place))
        left = final >= 0
        ends = np.r_[0, np.cumsum(left)][bounds].tolist()
        char = np.flatnonzero(left)
        ids = final[char]
        odd = set(np.searchsorted(bounds, char[ids >= self.size], "right").tolist())
        ids = list(map(self.numbers.__getitem__, ids.tolist()))
        for j, k in enumerate(short):
            a, b = ends[j], ends[j + 1]
            if j + 1 in odd:
                out[k] = tuple(chain.from_iterable([i] if i < self.size else self.byte_ids(chr(points[c])) for i, c in zip(ids[a:b], char[a:b].tolist())))
            else:
                out[k] = tuple(ids[a:b])
        for j in np.flatnonzero(strict):
            out[short[j]] = self.merge_one(words[short[j]])
        return out

    def byte_ids(self, text: str) -> list[int]:
        return [self.byte0 + b for b in text.encode("utf-8", "surrogatepass")]

    def merge_one(self, word: str) -> tuple[int, ...]:
        """One word, always the best and then leftmost pair next; O(n log n)."""
        sym = [self.symbol.get(c, self.unknown) for c in word]
        n = len(sym)
        left, right, text = list(range(-1, n - 1)), [*range(1, n), -1], list(word)
        heap = [(*self.pairs[p], i, *p) for i, p in enumerate(zip(sym, sym[1:])) if p in self.pairs]
        heap = [(r, i, a, b, m) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = m, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (p := (sym[x], sym[y])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], x, *p, self.pairs[p][1]))
        return tuple(chain.from_iterable([s] if s < self.size else self.byte_ids(text[i]) for i, s in enumerate(sym) if s >= 0))

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cut = [(BLANK + t.replace(" ", BLANK)) if t else "" for t in texts]
        parts = [_words(t) for t in cut]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        fresh = list(set(chain.from_iterable(parts)).difference(self.cache))
        self.cache.update(zip(fresh, self.merge_words(fresh)))
        return [list(chain.from_iterable(map(self.cache.__getitem__, p))) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding puts before a text goes."""
        data = b"".join(map(self.octets.__getitem__, ids))
        if ids and self.opens[ids[0]]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "one_by_one")


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _words(text: str) -> list[str]:
    """text cut before each run of blanks."""
    if not text:
        return []
    if BLANK * 2 not in text:
        return [BLANK + w for w in text[1:].split(BLANK)]
    return re.findall(f"{BLANK}+[^{BLANK}]*", text)


codecs.register_error("one_by_one", _one_by_one)


@functools.lru_cache(maxsize=2)
def load(model_path: str) -> PieceBPE:
    return PieceBPE(model_path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of ids for each text and, if named, one with the text decoded
    from them; a name that docs has already gets underscores before it. model_path must be
    readable on every executor. No shuffle; rows stay where they are read."""
    ids = free_name(docs.columns, ids)
    decoded = decoded and free_name([*docs.columns, ids], decoded)
    place = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = bpe.encode(part.column(place).to_pylist())
                cols = [*part.columns, pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, ids, *([decoded] if decoded else [])])
        bpe.cache.clear()

    return docs.mapInArrow(lean(run), schema)


def encoding_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(map(len, found), pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(bpe.decimal.__getitem__, x)).encode()).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.cache.clear()

    return docs.select(key, text).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
