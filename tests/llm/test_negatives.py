"""Hard negatives against a plain search."""

from collections import Counter

import numpy as np
import pytest

from roadmesh.llm import negatives


def plain(rows, anchors, low=80):
    out = []
    fine = [(i, x, np.array(v, object)) for i, x, v in rows if None not in (i, x, v)]
    for a, label, u in [(i, x, np.array(v, object)) for i, x, v in anchors if None not in (i, x, v)]:
        scored = sorted(((int(u @ v), i, x) for i, x, v in fine if i != a), key=lambda r: (-r[0], r[1]))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            window = [r for r in scored if r[2] != label and low * s <= 100 * r[0] <= 100 * s]
            out += [(a, p, k + 1, n, s, t) for k, (t, n, _) in enumerate(window[:5])]
    return Counter(out)


def run(spark, rows, anchors, **options):
    frame = lambda some: spark.createDataFrame([(*r, "x", 1) for r in some], "id long, label long, v array<long>, block string, cell int")
    got = negatives.hard_negatives(frame(rows), frame(anchors), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 8)) * 60
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in middle[i % 6] + rng.normal(size=8) * 15]) for i in range(900)]
    rows += [(900 + i, i % 3, rows[7][2]) for i in range(60)]  # one vector many times: ties
    rows += [(7, 1, rows[9][2]), (20, 2, rows[3][2]), (1001, None, rows[1][2]), (1002, 1, None), (None, 1, rows[2][2]), (1003, 2, [0] * 8), (1004, 9, [5] * 8)]
    return rows


def test_equal_a_plain_search(spark, rows):
    anchors = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    assert run(spark, rows, anchors) == plain(rows, anchors)


def test_many_cells_pieces_and_blocks(spark, rows):
    anchors = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    assert run(spark, rows, anchors, piece_rows=70, block_anchors=8, cluster_anchors=4) == plain(rows, anchors)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [int(x) for x in rng.integers(2**28, 2**28 + 40, 4)]) for i in range(60)]
    assert run(spark, rows, rows[::20]) == plain(rows, rows[::20])


def test_walks_stop_early(rows):
    """Bounds exclude rows: anchors close to their centre score less than half of the rows."""
    scored = []

    class Told(negatives._Shared):
        def scores(self, at, anchors):
            scored.append(len(at) * len(anchors))
            return super().scores(at, anchors)

    some = [r for r in rows if None not in r][:900]
    v = np.array([r[2] for r in some])
    shared = Told(np.arange(900), np.zeros(900, np.int64), v)
    mine = np.arange(0, 60, 6)
    centre = negatives._unit(v[mine].astype(float).mean(0, keepdims=True))[0]
    wanted = negatives._Positives(shared, mine, np.zeros(len(mine), np.int64), np.full(len(mine), -np.inf), 5)
    negatives._walk(shared, v[mine], centre, negatives._angle(v[mine].astype(float), centre).max(), wanted)
    assert sum(scored) < 0.5 * 900 * len(mine)
    for i, (score, ids) in zip(mine, wanted.found):
        best = sorted(((-int(v[i] @ v[j]), j) for j in range(900) if j != i))[:5]
        assert [(-s, j) for s, j in best] == list(zip(score.tolist(), ids.tolist()))


def test_no_rows(spark):
    assert not run(spark, [], []) and not run(spark, [(1, 1, [1, 2])], []) and not run(spark, [], [(1, 1, [1, 2])]) and not run(spark, [(1, 1, [])], [(1, 1, [])])
