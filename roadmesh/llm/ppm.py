"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A pretrained byte-context trie: for contexts of up to ORDER bytes it holds how often each
byte followed in the training texts. A byte is coded in the longest context that was seen at
least LEAST times; each context left on the way costs its escape probability, and the bytes
that the longer context had seen are excluded from the shorter one's distribution (symbol
exclusion). Of a context seen n times with d different bytes, after exclusion, a byte seen c
times has (2c - 1) / 2n and the escape d / 2n. Below order 0 all bytes not yet excluded are
equally likely.

A text is its tokens, A-Z lower-cased: words, each ended by one blank, then one end symbol (a
line feed, which no word holds). Contexts run on over the blank into the last TAIL bytes of
the word before. So a token's code length is the sum of two pieces': the head (those TAIL
bytes, the blank and the token's first HEAD bytes) and, for the bytes after these, the word
by itself, as their contexts reach back no further than its blank. Both kinds of pieces are
counted over all training texts, each distinct piece is scored once, and a document's score
is the sum over its pieces. The probabilities of all token sequences sum to at most 1.

No entry is pruned and no count is capped: pieces and trie are tables, which grow with the
corpus. Contexts are keyed with the latest byte first, so that a sort puts all contexts with
the same ending next to each other: a task takes the contexts that share their last three
bytes and finds there all that the orders 3 to ORDER need; orders 0 to 2 (2^24 entries at the
very most) are sent to all tasks. The most frequent words, heads and trie entries (bounded
numbers of them) are looked up where texts and pieces are read, all others by joins; this
changes no result, but no shuffle has a frequent key.

Edge cases: null and empty texts are one end token; a null id is held out (its checksum is
unknown); without training rows every byte has probability 1/256 and the base's counts are
0. Repeated rows each count and each get their row; an empty table gives none. Very long
texts are counted and scored whole, in memory linear in the text. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, lean, stored

ORDER, TAIL, HEAD, LEAST = 6, 2, 5, 8
#: So many pieces and trie entries at most are looked up without a join.
HOT_WORDS, HOT_HEADS, HOT_KEYS = 1 << 17, 1 << 19, 1 << 20
END = b"\n"
_FLUSH = 300_000
_SLICE = 512
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def tokens(text: str | None) -> list[bytes]:
    """The words of a text as bytes, A-Z lower-cased, without the end token."""
    return (text or "").encode().translate(LOWER_TABLE).split()


def heads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the head of each token, end tokens included: TAIL bytes of the
    word before (a line feed before the first one) and HEAD bytes of the token and its blank,
    zeros where there are fewer, packed into a number."""
    flat = np.frombuffer(b"".join(t + END for t in texts), np.uint8).astype(np.int64)
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _SPACE[flat]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]][: len(flat)])
    end = np.flatnonzero(~space & np.r_[space[1:], True][: len(flat)]) + 1
    text = np.searchsorted(ends_at, start, "right")
    # end tokens take their place behind the last word of their text
    every = np.concatenate([text, np.arange(len(texts))])
    order = np.lexsort((np.r_[start, ends_at], every))
    tail = np.where(end - start > 1, flat[np.maximum(end - 2, 0)], 0) << 8 | flat[end - 1]
    tail = np.concatenate([tail, np.zeros(len(texts), np.int64)])[order]
    begin = np.zeros(len(start), np.int64)
    for j in range(HEAD):
        at = start + j
        begin = begin << 8 | np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.where(at == end, 32, 0))
    begin = np.concatenate([begin, np.full(len(texts), END[0] << 8 * (HEAD - 1), np.int64)])[order]
    every = every[order]
    before = np.r_[0, tail[:-1]][: len(tail)]
    before[np.r_[True, every[1:] != every[:-1]][: len(every)]] = END[0]
    return every, before << 8 * HEAD | begin


def _binary(head: np.ndarray) -> pa.Array:
    """Heads as pieces: a blank, with which no word begins, and the head's bytes."""
    wide = (head | 32 << 8 * (TAIL + HEAD)).astype(">i8")
    return pa.Array.from_buffers(pa.binary(8), len(wide), [None, pa.py_buffer(wide.tobytes())]).cast(pa.binary())


def _spelled(piece: bytes) -> tuple[bytes, int]:
    """The bytes of a piece with the context before them, and how many of them aren't its own."""
    if piece[0] != 32:
        return b" " + piece + (b" " if piece != END else b""), 1 + HEAD
    body = piece[1 + TAIL :]
    stop = 0 if body[:1] == END else body.find(b" ")
    return piece[1 : 1 + TAIL] + b" " + (body[: stop + 1] if stop >= 0 else body), TAIL + 1


def trie_keys(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that the pieces code: the piece's number and the key, which is the ORDER
    bytes before it, the latest one first, and the byte."""
    told = [(i, *_spelled(p)) for i, p in enumerate(pieces) if p[0] == 32 or len(p) >= HEAD]
    number = np.array([i for i, _, _ in told], np.int64)
    length = np.fromiter((len(s) for _, s, _ in told), np.int64, len(told))
    flat = np.frombuffer(b"".join(s for _, s, _ in told), np.uint8).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    key = flat.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= np.where(place[k:] >= k, flat[:-k], 0) << 8 * (ORDER + 1 - k)
    own = place >= np.repeat(np.array([n for _, _, n in told], np.int64), length)
    return np.repeat(number, length)[own], key[own]


class Level(NamedTuple):
    """The trie's entries (context and byte) of one order that were seen, and its contexts."""

    entry: np.ndarray
    n: np.ndarray
    node: np.ndarray
    first: np.ndarray
    total: np.ndarray
    distinct: np.ndarray


def level(entry: np.ndarray, n: np.ndarray) -> Level:
    entry, place = np.unique(entry, return_inverse=True)
    n = np.bincount(place, n, len(entry)).astype(np.float64)
    node, first = np.unique(entry >> 8, return_index=True)
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
    return Level(entry, n, node, first, total, np.diff(np.r_[first, len(entry)]).astype(np.float64))


def shorter(entry: np.ndarray, by: int = 1) -> np.ndarray:
    """The entries without the oldest bytes of their contexts."""
    return entry >> 8 * (by + 1) << 8 | entry & 255


def excluded(long: Level, short: Level) -> np.ndarray:
    """How often, in the next shorter context, the bytes were seen that each context of long saw."""
    if not len(long.entry):
        return np.zeros(0)
    return np.add.reduceat(short.n[np.searchsorted(short.entry, shorter(long.entry))], long.first)


class Trie:
    """Scores keys: orders 0 to 2 come from ``low`` (entries of order 2), the others from
    the keys of a block, which holds all keys of the contexts that end like its own."""

    LOW = 2

    def __init__(self, entry: np.ndarray, n: np.ndarray):
        self.low = [level(shorter(entry, self.LOW - k), n) if k < self.LOW else level(entry, n) for k in range(self.LOW + 1)]
        self.lost = [excluded(self.low[k + 1], self.low[k]) for k in range(self.LOW)]

    def log10(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log10 probability of each of a block's keys' bytes; n: how often each was seen."""
        seen = n > 0
        levels = [*self.low, *(level(shorter(keys[seen], ORDER - k) if k < ORDER else keys[seen], n[seen]) for k in range(self.LOW + 1, ORDER + 1))]
        lost = [*self.lost, *(excluded(levels[k + 1], levels[k]) for k in range(self.LOW, ORDER))]
        score, open_ = np.zeros(len(keys)), np.arange(len(keys))
        came = np.full(len(keys), -1)  # the context of the order before, if it was tried
        for k in range(ORDER, -1, -1):
            own = levels[k]
            if not len(own.node) or not len(open_):
                continue
            entry = shorter(keys[open_], ORDER - k) if k < ORDER else keys[open_]
            mine = np.minimum(np.searchsorted(own.node, entry >> 8), len(own.node) - 1)
            tried = (own.node[mine] == entry >> 8) & ((own.total[mine] >= LEAST) | (k == 0))
            at = np.minimum(np.searchsorted(own.entry, entry), len(own.entry) - 1)
            hit = tried & (own.entry[at] == entry)
            left, kinds, before = own.total[mine], own.distinct[mine], came[open_]
            if k < ORDER and len(levels[k + 1].node):
                left = left - np.where(before >= 0, lost[k][before], 0.0)
                kinds = kinds - np.where(before >= 0, levels[k + 1].distinct[before], 0.0)
            gone = tried & ~hit & (kinds > 0)
            score[open_[hit]] += np.log10((2 * own.n[at[hit]] - 1) / (2 * left[hit]))
            score[open_[gone]] += np.log10(kinds[gone] / (2 * left[gone]))
            came[open_] = np.where(tried, mine, -1)
            open_ = open_[~hit]
        rest = 256.0 - (self.low[0].distinct[0] if len(self.low[0].node) else 0.0)
        score[open_] -= np.log10(max(rest, 1.0))
        return score


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, n: partial counts; pieces of held-out texts count 0."""
    words: Counter = Counter()
    some: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        head, place = np.unique(np.concatenate([h for h, _ in some]), return_inverse=True)
        return head, np.bincount(place, np.concatenate([n for _, n in some]), len(head)).astype(np.int64)

    def flush():
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["piece", "n"])
            words.clear()
        if some:
            head, n = merged()
            yield pa.RecordBatch.from_arrays([_binary(head), pa.array(n)], ["piece", "n"])
            some.clear()

    for b in batches:
        for at in range(0, b.num_rows, _SLICE):
            part = b.slice(at, _SLICE)
            out = part.column(1).to_numpy(zero_copy_only=False)
            texts = [(t or "").encode().translate(LOWER_TABLE) for t in part.column(0).to_pylist()]
            for text, held in zip(texts, out):
                if held:
                    for w in text.split():
                        words.setdefault(w, 0)
                else:
                    words.update(text.split())
            trained = int((~out).sum())
            words[END] += trained
            number, head = heads(texts)
            kinds, place = np.unique(head, return_inverse=True)
            some.append((kinds, np.bincount(place, ~out[number], len(kinds)).astype(np.int64)))
            if len(some) > 64:
                some[:] = [merged()]
            if len(words) > _FLUSH or some and len(some[0][0]) > 4 * _FLUSH:
                yield from flush()
    yield from flush()


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n (how often its byte was seen there in training), m (how many pieces hold it)."""
    for b in batches:
        for at in range(0, b.num_rows, 50_000):
            part = b.slice(at, 50_000)
            number, key = trie_keys(part.column(0).to_pylist())
            key, place = np.unique(key, return_inverse=True)
            n = np.bincount(place, part.column(1).to_numpy(zero_copy_only=False)[number], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64)), pa.array(np.bincount(place, minlength=len(key)).astype(np.int64))], ["key", "n", "m"])


def _score_keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key; contexts that may go on in the next batch are held back."""
        trie, held = shared.value, None

        def told(key, n, m):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(m), pa.array(trie.log10(key, n))], ["key", "m", "score"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            ending = cols[0] >> 32
            cut = int(np.searchsorted(ending, ending[-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield told(*(c[:cut] for c in cols))
        if held is not None and len(held[0]):
            yield told(*held)

    return run


def train(pieces: DataFrame) -> DataFrame:
    """key, m, score (log10 probability) of all keys of pieces(piece, n)."""
    keys = stored(pieces.select("piece", "n").mapInArrow(lean(_count_keys), "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    low = keys.where("n > 0").groupBy((F.shiftleft(F.shiftright("key", 8 * (ORDER - Trie.LOW + 1)), 8) + F.col("key") % 256).alias("entry")).agg(F.sum("n").alias("n")).toArrow()
    shared = keys.sparkSession.sparkContext.broadcast(Trie(low.column("entry").to_numpy(), low.column("n").to_numpy()))
    dealt = keys.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").select("key", "n", "m")
    return stored(dealt.mapInArrow(lean(_score_keys(shared)), "key long, m long, score double"))


def most_frequent(df: DataFrame, col: str, most: int) -> Column:
    """A condition on col that holds for the rows of its highest values, for most rows at most."""
    bin_ = F.floor(16 * F.log2(F.greatest(F.col(col), F.lit(1))))
    least, n = None, 0
    for b, count in sorted(df.groupBy(bin_.alias("b")).count().collect(), reverse=True):
        n += count
        if n > most:
            break
        least = b
    return F.lit(False) if least is None else bin_ >= least


def score_pieces(pieces: DataFrame, keys: DataFrame, shared) -> DataFrame:
    """piece, n and score of pieces(piece, n); shared: the most frequent keys and their scores."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, value = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                part = b.slice(at, 50_000)
                number, key = trie_keys(part.column(0).to_pylist())
                place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                score = np.bincount(number, np.where(hot[place] == key, value[place], 0.0), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["piece", "n", "score"])

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _ = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                names = b.column(0).slice(at, 50_000)
                number, key = trie_keys(names.to_pylist())
                rare = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] != key
                pair = np.unique(np.column_stack([number[rare], key[rare]]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(pair[0][:, 0])), pa.array(np.ascontiguousarray(pair[0][:, 1])), pa.array(pair[1].astype(np.int32))], ["piece", "key", "tf"])

    rest = pieces.select("piece").mapInArrow(lean(other), "piece binary, key long, tf int").join(keys.select("key", "score"), "key")
    rest = rest.groupBy("piece").agg(F.sum(F.col("tf") * F.col("score")).alias("score")).select("piece", F.lit(0).cast("long").alias("n"), "score")
    both = pieces.select("piece", "n").mapInArrow(lean(known), "piece binary, n long, score double").unionByName(rest)
    return both.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))


_SUMS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]


def _document_parts(shared):
    """Of each document: a row with the sums over its frequent pieces, and a row for each
    other piece. The first kind has a piece of its own that no text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_heads, value = shared.value["words"], shared.value["heads"], shared.value["scores"]
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                part = b.slice(at, _SLICE)
                rows = part.column(0).to_numpy(zero_copy_only=False)
                texts = [(t or "").encode().translate(LOWER_TABLE) for t in part.column(2).to_pylist()]
                number, head = heads(texts)
                order = np.lexsort((head, number))
                number, head = number[order], head[order]
                first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (number[1:] != number[:-1])][: len(head)])
                tf = np.diff(np.r_[first, len(head)])
                number, head = number[first], head[first]
                place = np.minimum(np.searchsorted(hot_heads, head), len(hot_heads) - 1)
                hit = hot_heads[place] == head
                score = np.bincount(number[hit], tf[hit] * value[place[hit]], len(texts))
                n_tokens, known, base, rare, owner, often = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    words.append(END)
                    k, s, t = 0, 0.0, 0.0
                    for w, n in Counter(words).items():
                        if x := hot_words.get(w):
                            k, s, t = k + n, s + n * x[0], t + n * x[1]
                        else:
                            rare.append(w), owner.append(i), often.append(n)
                    n_tokens.append(len(words)), known.append(k), base.append(s)
                    score[i] += t
                miss = ~hit
                own = pa.array([b"  %d" % r for r in rows.tolist()], pa.binary())
                piece = pa.concat_arrays([own, pa.array(rare, pa.binary()), _binary(head[miss])])
                row = np.concatenate([rows, rows[np.array(owner, np.int64)], rows[number[miss]]])
                count = np.concatenate([np.zeros(len(rows), np.int64), np.array(often, np.int64), tf[miss]])
                none = len(row) - len(rows)
                sums = [part.column(1), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)]
                filled = [pa.concat_arrays([s.cast(t), pa.nulls(none, t)]) for s, (_, t) in zip(sums, _SUMS)]
                yield pa.RecordBatch.from_arrays([pa.array(row), piece, pa.array(count.astype(np.int32)), *filled], ["row", "piece", "tf", *(n for n, _ in _SUMS)])

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, hot: tuple[int, int, int] = (HOT_WORDS, HOT_HEADS, HOT_KEYS)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.
    Learns from rows whose crc32(key as text) mod folds isn't 0. hot: at most so many words,
    heads and trie entries are looked up without a join."""
    context = docs.sparkSession.sparkContext
    out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == 0, F.lit(True))
    pieces = docs.select(F.col(text).alias("text"), out(key).alias("out")).mapInArrow(lean(_count_pieces), "piece binary, n long")
    pieces = stored(pieces.groupBy("piece").agg(F.sum("n").alias("n")))
    is_word = F.substring("piece", 1, 1) != F.lit(b" ")
    seen, distinct = pieces.where(is_word & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = seen + 0.1 * (distinct + 1)
    base = F.log10((F.col("n") + 0.1) / whole)
    keys = train(pieces)
    top = keys.where(most_frequent(keys, "m", hot[2])).select("key", "score").toArrow().sort_by("key")
    shared = context.broadcast((np.r_[top.column("key").to_numpy(), 1 << 62], np.r_[top.column("score").to_numpy(), 0.0]))
    seen_pieces = pieces.where("n > 0")
    frequent = F.coalesce((F.col("n") > 0) & F.when(is_word, most_frequent(seen_pieces.where(is_word), "n", hot[0])).otherwise(most_frequent(seen_pieces.where(~is_word), "n", hot[1])), F.lit(False))
    top = score_pieces(pieces.where(frequent), keys, shared).withColumn("base", base).toArrow()
    names, value, bases = top.column("piece").to_pylist(), top.column("score").to_numpy(), top.column("base").to_numpy()
    is_head = np.array([p[0] == 32 for p in names], bool)
    head = np.array([int.from_bytes(p[1:], "big") for p in names if p[0] == 32], np.int64)
    order = np.argsort(head)
    words = {p: (float(x), float(y)) for p, x, y in zip(names, bases, value) if p[0] != 32}
    told = context.broadcast({"words": words, "heads": np.r_[head[order], 1 << 62], "scores": np.r_[value[is_head][order], 0.0]})
    others = score_pieces(pieces.where(~frequent), keys, shared).select(F.col("piece").alias("p"), F.when(is_word, (F.col("n") > 0).cast("int")).otherwise(0).alias("k"), F.when(is_word, base).otherwise(0.0).alias("b"), F.col("score").alias("s"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = rows.mapInArrow(lean(_document_parts(told)), "row long, piece binary, tf int, doc_id long, n_tokens long, n_known long, base double, score double")
    joined = parts.join(others, parts["piece"] == others["p"], "left")
    plus = lambda own, other: F.sum(F.coalesce(own, F.lit(0)) + F.coalesce(F.col("tf") * F.col(other), F.lit(0)))
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), plus("n_known", "k").alias("n_known"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))
    return sums.select("doc_id", out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(seen)).cast("long").alias("train_tokens"), "base_score", "score")
