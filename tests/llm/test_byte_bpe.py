"""Byte-level BPE against the public library, made-up rank tables and hand-made cases."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from roadmesh.llm import byte_bpe
from roadmesh.llm.queries import ranks_path

TEXTS = [
    None, "", " ", "a", "A b\tc\n", "it's we'll  two  blanks \n\n x", "über straße ñandú 漢字", "😀" * 3, "x" * 3000, "ab" * 4000, "0123456789" * 300, "=" * 900, " " * 900, "\x00\x1c\x85  　 y",
    "<|endoftext|>", "word " * 400, "á", "A b\tc\n",
]


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.load(ranks_path()).ranks, special_tokens={})


def test_ids_and_digests_equal_the_library(spark, lib):
    rows = [(i if i != 3 else None, t, "s", [i]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n array<int>")
    got = byte_bpe.encode_documents(docs, ranks_path(), decoded="ids").collect()
    assert len(got) == len(TEXTS) and got[0].__fields__ == ["doc_id", "text", "ids", "n", "_ids", "__ids"]
    for r in got:
        assert r["_ids"] == lib.encode_ordinary(r["text"] or "") and bytes(r["__ids"]) == (r["text"] or "").encode()
    digests = byte_bpe.encoding_digests(docs, ranks_path()).collect()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode_bytes(ids)).hexdigest()))
    assert sorted(map(tuple, digests), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encoding_digests(docs.where("false"), ranks_path()).count() == 0
    back = byte_bpe.decode_documents(spark.createDataFrame([(1, [300, 40, 300]), (2, []), (3, None)], "ids long, x array<int>"), ranks_path(), ids="x")
    assert [r["decoded"] and bytes(r["decoded"]) for r in back.orderBy("ids").collect()] == [lib.decode_bytes([300, 40, 300]), b"", None]


def test_random_texts_equal_the_library(lib):
    bpe, rng = byte_bpe.load(ranks_path()), np.random.default_rng(1)
    texts = ["".join(rng.choice(list(" aabeinrst.,#é漢\n'0123\t\x1c\x85"), rng.integers(0, 80))) for _ in range(2000)]
    texts += ["".join(rng.choice(list("aabeinrstlo"), rng.integers(1, 3000))) for _ in range(30)]
    codes = bpe.encode(texts)
    assert codes == [lib.encode_ordinary(t) for t in texts]
    assert [bpe.decode(c) for c in codes] == [t.encode() for t in texts]


def plain(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


@pytest.mark.parametrize("seed", range(40))
def test_joins_hold_for_any_ranks(seed):
    """Tables in which longer tokens may rank before their parts, so that merges go up and down in rank."""
    rng = random.Random(seed)
    some = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(50)})
    rng.shuffle(some)
    bpe = byte_bpe.ByteBPE({t: i for i, t in enumerate([*map(bytes, zip(range(256))), *some])})
    for _ in range(60):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
        assert bpe.merge(data) == bpe.reduce(data) == plain(bpe.ranks, data)
        cut = rng.randint(0, len(data))
        assert bpe.join(plain(bpe.ranks, data[:cut]), plain(bpe.ranks, data[cut:])) == plain(bpe.ranks, data)


def test_a_table_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.ByteBPE({b"a": 0})
