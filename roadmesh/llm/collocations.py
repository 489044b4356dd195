"""Collocations of two and three words by stripes.

A stripe is the associative counter of a prefix: next word -> occurrences. Stripes of the same
prefix are merged element by element, so tasks count in memory and shuffle one row for each
first word, with the stripes of the prefixes that begin with it beside each other. Everything
comes from this one structure, one level at a time:

- the stripe of the empty prefix holds the words' counts; its total is n,
- the stripe of a word holds the counts of the pairs that it begins,
- the stripe of a pair holds those of the phrases of three words,
- the total of a prefix's stripe (with its occurrences at the end of a piece) is the prefix's
  count: it stands as a cell in the stripe of the shorter prefix and is looked up there,
- merged by maximum instead of sum, over their first words or along a stripe, the cells of the
  last level give each pair's most frequent longer phrase.

A phrase occurs at most as often as its parts. So a level extends phrases only where both parts
have the least count. Tasks learn this from a table of bits of a fixed size, in which each
frequent phrase has set two: a false hit costs a row, no count is changed and none is lost.

Hot words, those with at least 1/HOT of all words of the corpus and so at most HOT of them, are
known after the first level; the stripes that begin with them are cut into SLICES by a hash of
the words that follow, so no task merges all stripes of a very common word. Merging runs on Spark's hash aggregation,
which spills; lookups of hot words' counts are joined by broadcast (at most HOT rows), all
others by a shuffle in which no key is hot.

Edge cases: null texts are empty; a null lang is `und`, the empty lang is one of its own.
Repeated rows each count. An empty table gives no rows. Very long texts are counted whole, in
memory linear in the text. Ties go as the order says, to the end: lang and phrase are unique.
Extra columns are ignored, whatever their names. Words are runs of any characters but blanks,
tabs and the separators; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER_TABLE, lean, stored

#: The separators of pieces: .,;:!? and the controls 10 to 13.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the table of frequent phrases (8 MB), hot words and their slices.
_LOG_BITS = 26
BITS, HOT, SLICES = 1 << _LOG_BITS, 1024, 64
_END = b"\xff"  # no UTF-8 text holds it
_TABLE = bytes(10 if b in SEPARATORS else 32 if b == 9 else LOWER_TABLE[b] for b in range(256))
#: Words and cells that a task counts before it passes them on; ids have 21 bits.
_WORDS, _CELLS, _BYTES, _RUN = 1 << 19, 1 << 21, 1 << 22, 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _bits(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """The two bits of phrases whose words have these hashes."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for word in hashes:
        h = (h ^ word) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
    return [(x >> np.uint64(64 - _LOG_BITS)).astype(np.int64) for x in (h, (h ^ h >> np.uint64(31)) * _MIX[0])]


class _Words(dict):
    """Numbers words as they come; 0 ends a piece."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 7)
        self.names: list[bytes] = []
        self.hashes: list[int] = []
        self[_END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


def _tokens(texts: list[str]) -> list[bytes]:
    """The words of texts, with _END after each piece."""
    data = "\n".join(texts).encode().translate(_TABLE).replace(b"\n", b" \xff ")
    return [*data.split(), _END]


def _bits_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """slot, mask: the bits of the phrases (lang and words) of a batch."""
        for b in batches:
            if not b.num_rows:
                continue
            seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 7) for lang in set(b.column(0).to_pylist())}
            seed = [seeds[lang] for lang in b.column(0).to_pylist()]
            hashes = [np.array([xxhash.xxh64_intdigest(w, s) for w, s in zip(b.column(1 + k).to_pylist(), seed)], np.uint64) for k in range(width)]
            bit = np.unique(np.concatenate(_bits(hashes)))
            slot, first = np.unique(bit >> 6, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.bitwise_or.reduceat(np.int64(1) << (bit & 63), first))], ["slot", "mask"])

    return run


def frequent_bits(phrases: DataFrame, width: int):
    """The broadcast table of bits of phrases(lang, w1, ...): BITS / 8 bytes, however many there are."""
    told = phrases.select("lang", *_columns(width)).mapInArrow(_bits_of(width), "slot int, mask long")
    rows = told.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(BITS >> 6, np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(table)


def _has(table: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([table[b >> 6] >> (b & 63) & 1 == 1 for b in bits])


def _columns(width: int) -> list[str]:
    return [f"w{k + 1}" for k in range(width)]


class _Counted:
    """The words of a lang as a task reads it, and the cells (phrase, count) it has counted."""

    def __init__(self, lang: str):
        self.words, self.some = _Words(lang), []

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.some.append((key, n))
        if sum(len(k) for k, _ in self.some[1:]) > max(_CELLS // 8, len(self.some[0][0])):
            self.some = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        key, place = np.unique(np.concatenate([k for k, _ in self.some]), return_inverse=True)
        return key, np.bincount(place, np.concatenate([n for _, n in self.some]), len(key)).astype(np.int64)

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.some)


def _cells(ids: np.ndarray, words: _Words, level: int, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of level words within pieces, as packed numbers, and their counts; those with
    a part (all words but the first or the last) that surely isn't frequent stay out."""
    n = len(ids) - level + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] > 0 for k in range(level)]))
    if level > 1:
        hashes = np.array(words.hashes, np.uint64)
        part = _has(table, _bits([hashes[ids[k : k + n + 1]] for k in range(level - 1)]))
        at = at[part[at] & part[at + 1]]
    key = ids[at]
    for k in range(1, level):
        key = key << 21 | ids[at + k]
    return np.unique(key, return_counts=True)


def _told(lang: str, counted: _Counted, level: int, hot: set[tuple]) -> Iterator[pa.RecordBatch]:
    """The stripes of a task's cells: a row for each first word, or each slice of a hot one, with
    the stripes of all prefixes that begin with it, one after the other."""
    words, (key, n) = counted.words, counted.merged()
    names, hashes, low = pa.array(words.names, pa.binary()), np.array(words.hashes, np.uint64), (1 << 21) - 1
    word = lambda k: key >> 21 * (level - 1 - k) & low
    first = word(0) if level > 1 else np.zeros(len(key), np.int64)
    mine = [words[w] for name, w in hot if name == lang and w in words]
    slices = np.zeros(len(key), np.int64)
    if level > 1 and mine:
        slices = np.where(np.isin(first, mine), (_bits([hashes[word(k)] for k in range(1, level)])[0] % SLICES) + 1, 0)
        order = np.lexsort((slices, first))
        key, n, slices, first = key[order], n[order], slices[order], first[order]
    for a in range(0, len(key), 100_000):
        z = slice(a, a + 100_000)
        at = np.flatnonzero(np.r_[True, (first[z][1:] != first[z][:-1]) | (slices[z][1:] != slices[z][:-1])])
        ends = pa.array(np.r_[at, len(key[z])].astype(np.int32))
        lists = [names.take(pa.array(word(k)[z])) for k in range(min(level - 1, 1), level)]
        cols = [*([names.take(pa.array(first[z][at]))] if level > 1 else []), pa.array(slices[z][at].astype(np.int32)), *(pa.ListArray.from_arrays(ends, x) for x in (*lists, pa.array(n[z])))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *cols], ["lang", *_key(level)[1:], *_cell(level), "counts"])


def _key(level: int) -> list[str]:
    """What stripes travel by."""
    return ["lang", *(["w1"] if level > 1 else []), "slice"]


def _cell(level: int) -> list[str]:
    return _columns(level)[min(level - 1, 1) :]


def _stripes(level: int, frequent, hot: set[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, _Counted] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counted in state.items():
                if len(counted):
                    yield from _told(lang, counted, level, hot)
            state.clear()

        for b in batches:
            texts, langs = b.column(0), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                mine, a = [i for i, x in enumerate(langs) if x == lang], 0
                while a < len(mine):  # bounded bytes at a time, but whole texts
                    part, size = [], 0
                    while a < len(mine) and (not part or size < _BYTES):
                        part.append(texts[mine[a]].as_py() or "")
                        size += len(part[-1])
                        a += 1
                    tokens = _tokens(part)
                    for k in range(0, len(tokens), _RUN):  # phrases belong to the run that they begin in
                        counted = state.setdefault(lang, _Counted(lang))
                        ids = np.array(list(map(counted.words.__getitem__, tokens[k : k + _RUN + level - 1])), np.int64)
                        counted.add(*_cells(ids, counted.words, level, frequent and frequent.value))
                        if sum(len(c.words) for c in state.values()) > _WORDS or sum(map(len, state.values())) > _CELLS:
                            yield from passed_on()
        yield from passed_on()

    return run


def merged_stripes(docs: DataFrame, level: int, least: int = 1, frequent=None, hot: set[tuple] = frozenset()) -> DataFrame:
    """lang, w1, ..., f: the phrases of level words that occur least times or more, all of docs
    (text, lang) counted. frequent: the bits of phrases of level - 1 words; hot: the words
    (lang, w1) whose stripes are cut into slices."""
    key, cell = _key(level), _cell(level)
    kinds = {"lang": "string", "w1": "binary", "slice": "int"}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), *(f"{c} array<binary>" for c in cell), "counts array<long>"])
    stripes = docs.mapInArrow(lean(_stripes(level, frequent, hot)), schema)
    if level > 1:  # stripes travel whole, and merge where they arrive
        stripes = stripes.repartition(*key)
    cells = stripes.select(*key, F.inline(F.arrays_zip(*cell, "counts")).alias(*cell, "c"))
    counted = cells.groupBy(*key, *cell).agg(F.sum("c").alias("f"))  # the empty prefix: its next words are dealt
    return counted.where(F.col("f") >= least).select("lang", *_columns(level), "f")


def _with_count(df: DataFrame, counts: DataFrame, words: list[str], name: str, bar: float) -> DataFrame:
    """df with the count of the phrase of its columns words; phrases of bar or more, few, by broadcast."""
    as_key = [F.col(f"w{k + 1}").alias(f"k{k}") for k in range(len(words))]
    same = lambda: [F.col("kl") == F.col("lang"), *(F.col(f"k{k}") == F.col(w) for k, w in enumerate(words))]
    told = lambda some, f: counts.where(some).select(F.col("lang").alias("kl"), *as_key, F.col("f").alias(f))
    keys = ["kl", *(f"k{k}" for k in range(len(words)))]
    df = df.join(F.broadcast(told(F.col("f") >= bar, "hot")), same(), "left").drop(*keys)
    # rows that have their count get a key that no word has, each its own: no shuffle is lopsided
    own = F.when(F.col("hot").isNull(), F.col(words[0])).otherwise(F.concat(F.unhex(F.lit("FF")), F.xxhash64(*(c for c in df.columns)).cast("string").cast("binary")))
    rest = told(F.col("f") < bar, "cold")
    on = [F.col("kl") == F.col("lang"), F.col("k0") == F.col("own"), *(F.col(f"k{k}") == F.col(w) for k, w in list(enumerate(words))[1:])]
    df = df.withColumn("own", own).join(rest, on, "left").withColumn(name, F.coalesce("hot", "cold"))
    return df.drop("hot", "cold", "own", *keys)


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 * a * a / (left * right)) in exact decimals, for counts below 10^15."""
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    square = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a, 15)).cast("decimal(22,0)") * wide(a, 15)
    return F.call_function("div", square, wide(left, 15) * wide(right, 15))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first top phrases of two and three words
    with a >= least occurrences, by score = floor(10^6 * a * a / (l * r)) of their lowest-scoring cut.
    Phrases within a longer one that occurs percent of their times or more are left out."""
    docs = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    one = stored(merged_stripes(docs, 1))
    n = stored(one.groupBy("lang").agg(F.sum("f").alias("n")))
    bar = max(((n.agg(F.sum("n")).first()[0]) or 0) / HOT, 1)
    hot = {(r["lang"], bytes(r["w1"])) for r in one.where(F.col("f") >= bar).select("lang", "w1").collect()}
    words = one.where(F.col("f") >= least)
    two = stored(merged_stripes(docs, 2, least, frequent_bits(words, 1), hot))
    three = stored(merged_stripes(docs, 3, least, frequent_bits(two, 2), hot))

    longer = F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    most = three.select("lang", longer.alias("p"), "f").select("lang", "p.*", "f").groupBy("lang", "w1", "w2").agg(F.max("f").alias("most"))
    pairs = two.withColumnRenamed("f", "a").join(most, ["lang", "w1", "w2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    pairs = _with_count(_with_count(pairs, words, ["w1"], "l", bar), words, ["w2"], "r", bar).withColumn("score", _score("a", "l", "r"))
    triples = three.withColumnRenamed("f", "a")
    for name, counts, part in (("l1", words, ["w1"]), ("r1", two, ["w2", "w3"]), ("l2", two, ["w1", "w2"]), ("r2", words, ["w3"])):
        triples = _with_count(triples, counts, part, name, bar)
    triples = triples.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    phrase = lambda width: F.concat_ws(" ", *(F.col(w).cast("string") for w in _columns(width))).alias("phrase")
    every = pairs.select("lang", phrase(2), "a", "l", "r", "score").unionByName(triples.select("lang", phrase(3), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = every.withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
