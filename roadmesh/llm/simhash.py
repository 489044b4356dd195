"""SimHash near duplicates by deletion-variant signatures.

A fingerprint has 64 bits, each set if over half of a document's shingle hashes set it.
Fingerprints of at most d differing bits are found without comparing all: cut into
d // 2 + 1 segments, at least one segment differs by at most one bit. Every segment is
indexed once for each of its bits with that bit as a wildcard; equal variants meet in a
sort and are verified over all 64 bits.

For a Jaccard similarity (``similar_groups``, ``dedup``) one fingerprint is too short: texts
of similarity 0.8 differ in some ten of 64 bits. There a signature has LANES fingerprints;
segments of SEGMENT bits are indexed with one wildcard each, a further lane filters what
meets, all bits filter again by a loose bound, and the exact Jaccard similarity of the sets
of shingle hashes decides. At 0.8 a pair meets in a segment with a chance of 0.28, in one of
sixteen with 0.995. Texts of equal signatures count as alike without a look at their sets.

Copies collapse first: one row per distinct fingerprint goes on. Where a variant has many
fingerprints, links are reduced to a spanning forest before they leave the task, so a
cluster of n yields at most n - 1 rows, and no set of pairs is made. A variant with more
than RUN of them is not held in a task: its fingerprints are dealt again by further bits.
Those of a link agree in the variant's bits, so of d + 1 parts of all other bits one at
least is equal; each part added to the variant's bits is a new, smaller variant. This goes
on until none is too large, as n free bits leave 2^n fingerprints at most. Links become
components by rounds of label spreading over written tables.

For a similarity such a forest is of loose links, so it only says which signatures belong to
one family; within a family all are compared, whether the forest joins them or not. A task
compares BLOCK members at most, twice as many when blocks meet. Large families are compared
block by block first, then what each block found is merged by one member of each of its
components. Members of the family's largest component need no further comparison with each
other; all others are then compared with every block. So a family of copies that are all
alike costs about its size, and only one whose members are not alike costs its square, spread
over many tasks.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a
text of fewer words than a shingle hashes as a whole. Repeated rows get their result each;
null ids give a null component only if no id of the component is known. An empty table gives
no rows. Very long texts are hashed whole, in memory linear in them. ``dedup`` keeps all
columns, whatever their names; the other functions ignore extra ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER_TABLE, free_name, lean, stored

#: Runs of a variant up to so many fingerprints are compared by shifts, longer ones by a
#: breadth-first walk.
SHORT_RUN = 12
#: Runs of a variant of more fingerprints are dealt again by further bits.
RUN = 4096
_BLOCK = 512


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, as an unsigned number."""
    import xxhash

    tokens = (text or "").encode().translate(LOWER_TABLE).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    starts, at = [0] * n, 0
    for i, t in enumerate(tokens):
        starts[i] = at
        at += len(t) + 1
    starts.append(at)
    count = n - words + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", words: int = 4, seed: int = 42) -> DataFrame:
    """docs with the fingerprint of each text as a (signed) long; text itself stays. If docs has
    a column of that name, the new one gets underscores before its name."""
    name, place = free_name(docs.columns, name), docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(place)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(lean(run), schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of distance // 2 + 1 segments of the 64 bits."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The wildcard bit of each variant and the bits that it fixes."""
    rows = [(bit, ((1 << n) - 1) << a & ~(1 << bit)) for a, n in segments(distance) for bit in range(a, a + n)]
    return np.array([b for b, _ in rows], np.int8), np.array([m for _, m in rows], np.uint64)


def _variants(distance: int):
    marks, masks = _masks(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                keys = (fp.view(np.uint64)[:, None] & masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(marks, len(fp)), pa.int8()), pa.array(keys.ravel()), pa.array(np.repeat(fp, len(masks)))], ["mark", "variant", "fp"])

    return run


def _smaller_variants(distance: int, first: bool):
    """Rows (mark, fp) of variants that are too large, as rows of distance + 1 smaller ones
    each. mark is a wildcard bit at first, later, as in what is returned, the fixed bits."""
    fixed = {int(b): int(m) for b, m in zip(*_masks(distance))}

    def parts(mark: int) -> np.ndarray:
        mask = fixed[mark] if first else mark % 2**64
        free = [1 << i for i in range(64) if not mask >> i & 1]
        edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
        return np.array([mask | sum(free[x:y]) for x, y in zip(edges, edges[1:])], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, fps = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for mark in np.unique(marks):
                masks, fp = parts(int(mark)), fps[marks == mark]
                keys = (fp.view(np.uint64)[:, None] & masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(masks.view(np.int64), len(fp))), pa.array(keys.ravel()), pa.array(np.repeat(fp, len(masks)))], ["mark", "variant", "fp"])

    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within fps, as two arrays of ends."""
    left, parents, children = fps.copy(), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:_BLOCK], front[_BLOCK:]
            near = _differing(some[:, None], left[None, :]) <= distance
            hit = near.any(0)
            parents.append(some[near[:, hit].argmax(0)])
            children.append(left[hit])
            front = np.concatenate([front, left[hit]])
            left = left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (none, none)


def _linker(distance: int, most: int):
    def links(mark: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links within runs of at most most fingerprints; the rows of larger ones."""
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        length = np.diff(np.r_[start, len(fp)])
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        run = np.repeat(np.where(length <= SHORT_RUN, np.arange(len(start)), -1 - np.arange(len(start))), length)
        for lag in range(1, SHORT_RUN):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & (run[lag:] >= 0))
            if not len(i):
                break
            i = i[_differing(fp[i], fp[i + lag]) <= distance]
            a.append(fp[i]), b.append(fp[i + lag])
        for k in np.flatnonzero((length > SHORT_RUN) & (length <= most)):
            x, y = _forest(fp[start[k] : start[k] + length[k]], distance)
            a.append(x), b.append(y)
        large = np.repeat(length > most, length)
        return _found(np.concatenate(a), np.concatenate(b), mark[large], fp[large])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by mark and variant; a run that goes on in the next batch is held back until
        it is too large, then it passes through."""
        held: list[np.ndarray] | None = None
        passing, none = None, np.zeros(0, np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[2] = cols[2].view(np.uint64)
            if passing and len(cols[0]):
                other = np.flatnonzero((cols[0] != passing[0]) | (cols[1] != passing[1]))
                end = other[0] if len(other) else len(cols[0])
                yield _found(none, none, cols[0][:end], cols[2][:end])
                cols = [c[end:] for c in cols]
                passing = None if len(other) else passing
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            mark, key, _ = cols
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (mark != mark[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(*(c[:cut] for c in cols))
            if len(held[0]) > most:
                yield _found(none, none, held[0], held[2])
                held, passing = None, (mark[-1], key[-1])
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def _found(a: np.ndarray, b: np.ndarray, mark: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Links a, b without a mark, then rows (fp, null, mark) of variants that are too large."""
    columns = [pa.array(np.concatenate([a, fp]).view(np.int64)), pa.array([*b.view(np.int64).tolist(), *[None] * len(fp)], pa.int64()), pa.array([*[None] * len(a), *mark.tolist()], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "mark"])


def fingerprint_links(fps: DataFrame, distance: int = 4, most: int = RUN) -> DataFrame:
    """a < b: links between distinct fingerprints (column fp) that connect every two of at
    most distance differing bits, directly or over others that are linked. most: how many
    fingerprints of a variant a task holds, 2^distance at least."""
    most, links, first = max(most, 1 << distance), None, True
    variants = fps.select("fp").distinct().mapInArrow(lean(_variants(distance)), "mark byte, variant long, fp long")
    while True:
        found = stored(variants.repartition(F.col("mark"), F.col("variant")).sortWithinPartitions("mark", "variant").mapInArrow(lean(_linker(distance, most)), "a long, b long, mark long"))
        now = found.where("mark is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.unionByName(now) if links is not None else now
        large = found.where("mark is not null").select("mark", F.col("a").alias("fp"))
        if large.isEmpty():
            return links.distinct()
        variants = large.mapInArrow(lean(_smaller_variants(distance, first)), "mark long, variant long, fp long").distinct()
        first = False


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, label: the least node of each node's component. Large-star and small-star
    rounds on written tables until nothing changes."""
    now = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"))
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(stored(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = stored(down.groupBy("u").agg(F.min("v").alias("m")))
        now = stored(down.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        if state[0] == state[2] and state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest id that links of at most distance
    differing bits reach."""
    marked = stored(with_fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "fp", words, seed).select("doc_id", "fp"))
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(fingerprint_links(least, distance))
    owned = least.join(labels, least["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = stored(owned.groupBy("label").agg(F.min("least").alias("component_id")))
    named = stored(owned.join(roots, "label").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


#: For a similarity instead of a distance: lanes of 64 bits, of which the first four are
#: cut into segments of SEGMENT bits, the next one filters and all together filter again.
LANES, INDEXED, SEGMENT = 8, 4, 16
#: Standard deviations that the last filter leaves above the expected bits: at the asked
#: similarity it loses about one pair in 30,000.
SPARE = 4.0
_LANE_MIX = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(LANES)], np.uint64)


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none for a text without words."""
    import xxhash

    tokens = (text or "").encode().translate(LOWER_TABLE).split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), seed) for i in range(n)), np.uint64, n))


def jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of a sorted set with each of others, none of them empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    same = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (len(one) + sizes - both)


def signature(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """LANES * 64 bits, each set if over half of the shingles' mixed hashes set it."""
    base = shingles(text, words, seed)
    if not len(base):
        return np.zeros(LANES, np.uint64)
    ones = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(base), 16384):
        x = base[at : at + 16384, None] * _LANE_MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(base), axis=1, bitorder="little").view(np.uint64).ravel()


def bits_apart(similarity: float, bits: int, spare: float = 1.3) -> int:
    """Differing bits, of so many, that sets of this Jaccard similarity stay within but for
    one pair in ten: the expected angle plus 1.3, or spare, standard deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + spare * np.sqrt(bits * p * (1 - p)))


def _wide_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, sketch, id: each segment once for each of its bits as a wildcard; a run is the number of
    segment and bit (slot), then the segment without the bit."""
    per = 64 // SEGMENT
    masks = np.array([((1 << SEGMENT) - 1) & ~(1 << b) for b in range(SEGMENT)], np.int64)
    slots = np.arange(INDEXED * per * SEGMENT, dtype=np.int64) << 32
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            lanes = np.column_stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(INDEXED)]).view(np.uint64)
            cut = (lanes[:, :, None] >> np.arange(0, 64, SEGMENT, dtype=np.uint64) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64).reshape(len(lanes), -1)
            keys = (cut[:, :, None] & masks).reshape(-1) | np.tile(slots, len(lanes))
            repeat = lambda i: pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), len(slots)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), repeat(1 + INDEXED), repeat(0)], ["run", "sketch", "id"])


LONG_RUN = 64
#: A run of more signatures is dealt to blocks of so many, and every two blocks meet in a task of their own.
RUN = 4096


#: A task that sorts runs gets the variants of so many signatures, in the mean.
SORTED = 4096


def _cells(classes: DataFrame) -> DataFrame:
    """cell, sketch, id: each segment once for each of its halves. A cell is the number of segment and half (side),
    what that half holds, and the segment's value. Runs fix one half whole and have their wildcard in the other one, so rows
    dealt by all but the value become runs() where they are, and eight times fewer rows are shuffled."""
    per, low = 64 // SEGMENT, (1 << SEGMENT // 2) - 1
    cells = []
    for i in range(INDEXED):
        for k in range(per):
            v = F.shiftrightunsigned(f"s{i}", k * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))
            for side, held in enumerate((F.shiftright(v, SEGMENT // 2), v.bitwiseAND(F.lit(low)))):
                cells.append((F.lit((((i * per + k) * 2 + side) << SEGMENT // 2)) + held) * F.lit(1 << SEGMENT) + v)
    return classes.select(F.explode(F.array(*cells)).alias("cell"), F.col(f"s{INDEXED}").alias("sketch"), F.col("rep").alias("id"))


def _held(cell: str = "cell"):
    """What cells are dealt by."""
    return F.shiftright(cell, SEGMENT)


def _runs(cells: DataFrame) -> DataFrame:
    """The rows of _wide_variants() from those of _cells()."""
    half, full = SEGMENT // 2, (1 << SEGMENT) - 1
    at, value = F.shiftright("cell", SEGMENT + half), F.col("cell").bitwiseAND(F.lit(full))  # at: segment and side
    low = at.bitwiseAND(F.lit(1)) == 0
    run = lambda j: (at * half + j) * F.lit(1 << 32) + value.bitwiseAND(F.when(low, F.lit(full & ~(1 << j))).otherwise(F.lit(full & ~(1 << j + half))))
    return cells.select(F.explode(F.array(*(run(j) for j in range(half)))).alias("run"), "sketch", "id")


def _run_sizes(classes: DataFrame, over: int = 0) -> DataFrame:
    """run, n: how many of classes(s0, s1, ...) a run of _wide_variants() has, from counts of the
    segments' values: a run is the two values that differ in its bit. Only runs of more than over: one of their
    values has over half of that, so few are counted whole."""
    per, full = 64 // SEGMENT, (1 << SEGMENT) - 1
    cells = [F.struct(F.lit(i * per + k).alias("at"), F.shiftrightunsigned(f"s{i}", k * SEGMENT).bitwiseAND(F.lit(full)).alias("v")) for i in range(INDEXED) for k in range(per)]
    counted = stored(classes.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.at", "c.v").agg(F.count("*").alias("n")))
    run = lambda b: F.shiftleft((F.col("at") * SEGMENT + b).cast("long"), 32).bitwiseOR(F.col("v").bitwiseAND(F.lit(full & ~(1 << b))))
    runs = F.explode(F.array(*(run(b) for b in range(SEGMENT)))).alias("run")
    every = counted.select(runs, "n")
    if over:
        every = every.join(stored(counted.where(2 * F.col("n") > over).select(runs).distinct()), "run", "left_semi")
    return every.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > over)


def _dealt(slots: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """slots with each run of more than most rows as runs of its own for every two blocks of it: each
    pair of its rows meets in one, so forests of the blocks' links connect what the run's would."""
    large = stored(_run_sizes(classes, most))
    if large.isEmpty():
        return slots
    return slots.join(large, "run", "left_anti").unionByName(_in_blocks(slots, large, most))


def _in_blocks(slots: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """The rows of the runs large(run, n) in runs of their own for every two blocks."""
    j = slots.join(large, "run").withColumn("blocks", F.ceil(F.col("n") / most))
    j = j.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> mine")
    # two runs of one hash would be compared as one, which adds candidates and loses none
    return j.select(F.xxhash64("run", F.least("mine", "other"), F.greatest("mine", "other")).alias("run"), "sketch", "id")


def _near(classes: DataFrame, apart: int, most: int) -> DataFrame:
    """a, b, dense of _wide_linker() for all runs of classes(rep, s0, s1, ...); a run of more than most goes in blocks."""
    link = lambda rows: rows.sortWithinPartitions("run", "id").mapInArrow(lean(_wide_linker(apart)), "a long, b long, dense boolean")
    rows = _runs(_cells(classes).repartition(1 + classes.count() // SORTED, _held()))
    large = stored(_run_sizes(classes, most))
    if large.isEmpty():
        return link(rows)
    slots = classes.select("rep", *(f"s{i}" for i in range(INDEXED + 1))).mapInArrow(lean(_wide_variants), "run long, sketch long, id long")
    return link(rows.join(large, "run", "left_anti")).unionByName(link(_in_blocks(slots, large, most).repartition("run")))


def _wide_linker(apart: int):
    """Pairs of ids that share a variant and whose sketches differ little; of a run
    with many of them only a spanning forest of stars (the least id, another), marked dense: it stands
    for all its pairs."""

    def links(key, sketch, ids):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        run = np.repeat(np.where(length <= LONG_RUN, np.arange(len(start)), -1 - np.arange(len(start))), length)
        a, b, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, LONG_RUN):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & (run[lag:] >= 0))
            if not len(i):
                break
            i = i[_differing(sketch[i], sketch[i + lag]) <= apart]
            a.append(ids[i]), b.append(ids[i + lag]), at.append(run[i])
        # a run with as many links as members keeps a spanning forest of them only
        where = np.concatenate(at)
        dense = (np.bincount(where, minlength=len(start)) >= length) | (length > LONG_RUN)
        few = ~dense[where]
        a, b = [np.concatenate(a)[few]], [np.concatenate(b)[few]]
        single = len(a[0])
        for k in np.flatnonzero(dense & (length > 1)):
            here = slice(start[k], start[k] + length[k])
            # a forest's trees become stars: every member is tied to the least id of its tree
            own, at = np.unique(sketch[here], return_inverse=True)
            up, (x, y) = np.arange(len(own)), _forest(own, apart)
            up[np.searchsorted(own, y)] = np.searchsorted(own, x)
            while not np.array_equal(above := up[up], up):
                up = above
            m, tree = ids[here], up[at]
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, tree, m)
            rest = m != least[tree]
            a.append(least[tree][rest]), b.append(m[rest])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= single)], ["a", "b", "dense"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero(cols[0] != cols[0][-1])
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(cols[0][:cut], cols[1][:cut].view(np.uint64), cols[2][:cut])
        if held is not None and len(held[0]):
            yield links(held[0], held[1].view(np.uint64), held[2])

    return run


#: So many members of a family at most are compared with each other in one task.
BLOCK = 256


def _group_labels(apart: int, words: int, similarity: float):
    """node, label: the least id that links of at least this similarity reach, from rows
    (group, id, lanes, text) sorted by group and id. Every two of a group are compared, by
    their sets if they are at most apart bits apart, but for those that are linked already."""

    def linked(lanes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """The place of the first member of each member's component."""
        label, left = np.arange(len(lanes)), np.arange(len(lanes))
        filled = np.array([len(x) > 0 for x in sets])
        while len(left):
            front, root, left = [left[0]], left[0], left[1:]
            while front and len(left):
                one = front.pop()
                hit = (_differing(lanes[one], lanes[left]).sum(1, dtype=np.int64) <= apart) & filled[left] & filled[one]
                if hit.any():
                    hit[hit] = jaccard(sets[one], [sets[i] for i in left[hit]]) >= similarity
                label[left[hit]] = root
                front.extend(left[hit].tolist())
                left = left[~hit]
        return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            ids = np.concatenate(held_ids)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[linked(np.concatenate(held_lanes), held_sets)])], ["node", "label"])

        now, held_ids, held_lanes, held_sets = None, [], [], []
        for b in batches:
            family, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            lanes = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(LANES)]).view(np.uint64)
            edges = [0, *(np.flatnonzero(family[1:] != family[:-1]) + 1), len(family)] if len(family) else []
            for start, end in zip(edges, edges[1:]):
                if held_ids and family[start] != now:
                    yield done()
                    held_ids, held_lanes, held_sets = [], [], []
                now = family[start]
                held_ids.append(ids[start:end]), held_lanes.append(lanes[start:end])
                held_sets.extend(shingles(t.as_py(), words) for t in b.column(2 + LANES).slice(start, end - start))
        if held_ids:
            yield done()

    return run


#: Members of a family, and characters of each, from which its order of shingles is counted; how many of the most
#: frequent ones the order tells apart; and members whose prefixes make one slice. Any order loses no link.
SAMPLED, SAMPLED_TEXT, ORDERED, SLICE = 1024, 20_000, 1 << 16, 1024


def _sampled_order(words: int):
    """family, shingles, counts: those of a family's sample(family, t) that come more than once, by hash."""

    def order(rows: pa.Table) -> pa.Table:
        own, n = np.unique(np.concatenate([shingles(t.as_py(), words) for t in rows["t"]]), return_counts=True)
        most = np.sort(np.argsort(-n, kind="stable")[:ORDERED])
        most = most[n[most] > 1]
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (own[most].view(np.int64), n[most])]
        return pa.table([rows["family"].combine_chunks()[:1], *lists], ["family", "shingles", "counts"])

    return order


def _prefixes(words: int, similarity: float):
    """family, slice, keys, owners of a block of rows(family, slices, rep, t): the shingles of its members' prefixes,
    each once, with the least member that prefixes tie to its own in this block; slice -1 has the
    members and those that they are tied to. A prefix is a set's rarest shingles, so many that two sets of at least
    this similarity share one: of n, all but as many as both must have, and one more."""

    def cut(mine: pa.Table, order: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64()))], ["family", "slice", "keys", "owners"])
        common, counts = (np.array(order[c][0].as_py() if order.num_rows else [], np.int64) for c in ("shingles", "counts"))
        common, reps, keys = common.view(np.uint64), mine["rep"].to_numpy(), []
        for t in mine["t"]:
            x = shingles(t.as_py(), words)
            known = np.zeros(len(x), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                known = np.where(common[at] == x, counts[at], 0)
            keys.append(x[np.lexsort((x, known))][: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1])
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        by_rep = np.argsort(reps, kind="stable")
        place = np.empty(len(reps), np.int64)
        place[by_rep] = np.arange(len(reps))
        member, up = np.repeat(place, [len(k) for k in keys]), np.arange(len(reps))
        least = np.full(len(own), len(reps))
        while True:  # the least place of a shingle's members, then of a member's shingles
            np.minimum.at(least, at, up[member])
            before = up.copy()
            np.minimum.at(up, member, least[at])
            if np.array_equal(before, up):
                break
        owners, slices = reps[by_rep][least], mine["slices"][0].as_py()
        slice_ = (own % np.uint64(slices)).astype(np.int64)
        parts = [np.flatnonzero(slice_ == k) for k in np.unique(slice_)]
        rows = [(-1, reps[by_rep].tolist(), reps[by_rep][up].tolist()), *((int(slice_[i[0]]), own[i].view(np.int64).tolist(), owners[i].tolist()) for i in parts)]
        family = pa.array([mine["family"][0].as_py()] * len(rows), pa.int64())
        return pa.table([family, *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))], ["family", "slice", "keys", "owners"])

    return cut


def _met(rows: pa.Table) -> pa.Table:
    """a < b: of the blocks' rows(keys, owners) of one slice, the owners of a key tied to its least one."""
    keys, owners = (np.concatenate([x.values.to_numpy() for x in rows[c]]) for c in ("keys", "owners"))
    at = np.lexsort((owners, keys))
    keys, owners = keys[at], owners[at]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = np.repeat(owners[start], np.diff(np.r_[start, len(keys)]))
    pairs = np.unique(np.column_stack([first, owners])[first != owners], axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def split_families(members: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """members(family, rep, t, ...) with smaller families, named by their least member: members that share no shingle
    of their prefixes, directly or over others, have no links (of at least this similarity), so they part.
    Members that share with nobody go."""
    n = members.groupBy("family").agg(F.count("*").alias("_n"))
    sized = members.join(n, "family")
    sample = sized.where(F.pmod(F.xxhash64("rep", F.lit(4)), F.ceil(F.col("_n") / SAMPLED)) == 0).select("family", F.substring("t", 1, SAMPLED_TEXT).alias("t"))
    order = stored(sample.groupBy("family").applyInArrow(_sampled_order(words), "family long, shingles array<long>, counts array<long>"))
    dealt = sized.select("family", F.pmod(F.xxhash64("rep", F.lit(0)), F.ceil(F.col("_n") / block)).alias("block"), F.ceil(F.col("_n") / SLICE).alias("slices"), "rep", "t")
    every = order.join(n, "family").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / block) - 1))).drop("_n")
    found = stored(dealt.groupBy("family", "block").cogroup(every.groupBy("family", "block")).applyInArrow(_prefixes(words, similarity), "family long, slice long, keys array<long>, owners array<long>"))
    inside = found.where("slice < 0").select(F.inline(F.arrays_zip("owners", "keys"))).toDF("a", "b").where("a <> b")
    across = found.where("slice >= 0").groupBy("family", "slice").applyInArrow(_met, "a long, b long")
    parts = gathered_components(inside.unionByName(across))
    return members.join(parts, F.col("rep") == F.col("node")).withColumn("family", F.col("label")).select(members.columns)


def _split(members: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """members with families of more than one block split."""
    large = stored(members.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > block).select("family"))
    if large.isEmpty():
        return members
    return stored(members.join(large, "family", "left_anti").unionByName(split_families(members.join(large, "family", "left_semi"), words, similarity, block)))


def family_labels(members: DataFrame, apart: int, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """node, label: the least member that links of at least this similarity reach, of the
    members(family, rep, lanes, t) of all families; members without links may be left out."""
    names = [f"s{i}" for i in range(LANES)]
    members = _split(stored(members), words, similarity, block)
    whole = stored(members.groupBy("family").agg(F.ceil(F.count("*") / block).alias("blocks")))
    deal = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    dealt = members.join(whole, "family").withColumn("block", deal(0, "blocks"))

    def labels(rows: DataFrame, *group: str) -> DataFrame:
        rows = rows.select(F.xxhash64(*group).alias("group"), "rep", *names, "t").repartition("group").sortWithinPartitions("group", "rep")
        return stored(rows.mapInArrow(lean(_group_labels(apart, words, similarity)), "node long, label long"))

    found = labels(dealt, "family", "block")
    wide = dealt.where("blocks > 1")
    if wide.isEmpty():
        return found
    leaders = wide.join(found.where("node = label").select(F.col("node").alias("rep")), "rep", "left_semi")
    many = leaders.groupBy("family").agg(F.ceil(F.count("*") / block).alias("parts"))
    found = found.unionByName(labels(leaders.join(many, "family").withColumn("part", deal(1, "parts")), "family", "part"))
    joined = gathered_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    named = stored(wide.select("family", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("family", "rep", F.coalesce("label", "rep").alias("part")))
    largest = named.groupBy("family", "part").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    rest = stored(named.join(largest, "family").where("part <> main").select("family", "rep"))
    if rest.isEmpty():
        return joined
    some = rest.groupBy("family").agg(F.ceil(F.count("*") / block).alias("others"))
    wide = wide.join(some, "family").withColumn("other", deal(2, "others"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = wide.withColumn("other", up_to("others"))
    again = wide.join(rest.select("rep"), "rep", "left_semi").withColumn("block", up_to("blocks"))
    found = found.unionByName(labels(every.unionByName(again.select(every.columns)), "family", "block", "other"))
    return gathered_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))


def similar_groups(docs: DataFrame, key: str, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, component: the smallest id that links of at least this Jaccard similarity of word
    shingles reach. key: a long that is not null and not repeated."""
    names = [f"s{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([signature(t.as_py(), words) for t in b.column(1)], np.uint64).reshape(-1, LANES).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["id", *names])

    signed = stored(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(lean(run), ", ".join(["id long", *(f"{n} long" for n in names)])))
    return signed_groups(signed, docs.select(F.col(key).alias("id"), F.col(text).alias("t")), words, similarity)


def gathered(links: DataFrame) -> DataFrame:
    """Links a < b that connect what the distinct links a < b do, in the end about one for each b: a member
    of many links is tied to the least of its other ends, and so are these. Stars' centres are few beside
    members, and many members name the same two, so links no longer grow with the stars that a member is in."""
    tied = stored(links.withColumn("m", F.min("a").over(W.partitionBy("b"))))
    return tied.where("a = m").select("a", "b").unionByName(tied.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def gathered_components(links: DataFrame) -> DataFrame:
    """components() of links a, b, gathered before."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return components(gathered(gathered(ends)))


#: Words of 64 bits that a table of bits has at most.
WORDS = 1 << 18


def marked(df: DataFrame, column: str, some: DataFrame, name: str = "_hit") -> DataFrame:
    """df with name, true where the column of that name is among some's longs, and by chance elsewhere: from a table of
    bits of at most WORDS words, which goes to all tasks, so that df isn't shuffled."""
    word, bits = free_name(df.columns, "word"), free_name(df.columns, "bits")
    place, bit = F.pmod(F.xxhash64(column), F.lit(WORDS)), F.pmod(F.xxhash64(column, F.lit(1)), F.lit(64)).cast("int")
    table = some.select(place.alias(word), bit.alias("_bit")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias(bits))
    hit = F.coalesce(F.getbit(F.col(bits), bit) == 1, F.lit(False))
    return df.withColumn(word, place).join(F.broadcast(table), word, "left").withColumn(name, hit).drop(word, bits)


def signed_groups(signed: DataFrame, texts: DataFrame, words: int, similarity: float, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """id, component: similar_groups() of texts(id, t), signed being (id, s0, s1, ...)."""
    names = [f"s{i}" for i in range(LANES)]
    classes = stored(signed.groupBy(*names).agg(F.min("id").alias("rep")))
    near = _near(classes, bits_apart(similarity, 64) + 6, run)
    near = stored(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dense").distinct())
    pairs = near.where("not dense").select("a", "b")
    side = lambda c: classes.select(F.col("rep").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names])
    wide = bits_apart(similarity, 64 * LANES, SPARE)
    apart = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names), F.lit(0))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= wide).select("a", "b")
    families = stored(gathered_components(links.unionByName(near.where("dense").select("a", "b"))))
    some = marked(texts, "id", families.select(F.col("node").alias("id"))).where("_hit").select("id", "t")  # the other texts aren't shuffled
    members = families.join(classes, families["node"] == classes["rep"]).join(some, F.col("rep") == F.col("id")).select(F.col("label").alias("family"), "rep", *names, "t")
    labels = family_labels(members, wide, words, similarity, block)
    owned = classes.join(labels, classes["rep"] == labels["node"], "left").select(*names, F.coalesce("label", "rep").alias("component"))
    return signed.join(stored(owned), names).select("id", "component")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest id."""
    mark = free_name(docs.columns, "row")
    numbered = stored(docs.withColumn(mark, F.monotonically_increasing_id()))
    groups = similar_groups(numbered, mark, text, words, similarity).select(F.col("id").alias("r"), F.col("component").alias("c"))
    members = groups.join(numbered.select(F.col(mark).alias("r"), F.col(key).alias("k")), "r")
    best = members.groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("n"), "k", "r")).alias("b"), F.count("*").alias("rows")).where("rows > 1").select("c", F.col("b.r").alias("first"))
    gone = stored(members.join(best, "c").where("r <> first").select(F.col("r").alias(mark)))
    # only rows that the bits name are shuffled, most of which go
    hit = free_name(numbered.columns, "hit")
    told = marked(numbered, mark, gone, hit)
    return told.where(~F.col(hit)).unionByName(told.where(F.col(hit)).join(gone, mark, "left_anti")).drop(mark, hit)
