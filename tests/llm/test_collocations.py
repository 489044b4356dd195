"""Collocations against a plain count."""

import re
from collections import Counter

import numpy as np
import pytest

from roadmesh.llm import collocations


def plain(rows, least, percent, top):
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *p) for p in zip(*(w[i:] for i in range(k))))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in found.items():
        if len(w) == 2 and any(100 * b >= percent * a for (other, *v), b in found.items() if other == lang and len(v) == 3 and w in (v[:2], v[1:])):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    rank, got = Counter(), []
    for lang, phrase, a, left, right, total, score in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase, a, left, right, total, score))
    return got


def check(spark, rows, least=3, percent=50, top=40):
    docs = spark.createDataFrame([(i, x, t, "w", 1, [2]) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, w1 string, f int, nexts array<int>")
    got = collocations.collocations(docs.repartition(3), least=least, percent=percent, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, least, percent, top))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢字", "a b", "x\x00", "\x1c", "it's", "-"]
    p = np.array([30, 10, 12, 6, 6, 6, 3, 3, 2, 2, 2, 2, 2.0])
    some = [" ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum())).replace("city of", "city\tof") for _ in range(120)]
    some = [t.replace(" - ", rng.choice([". ", "\n", ";", "  ", "\x0b", " "])) for t in some]
    texts = [*some, None, "", " \t ", "...", "new york city " * 3000, "new york city. " * 40, *["same text here"] * 30]
    return [([None, "", "en", "en", "en", "de"][i % 6], t) for i, t in enumerate(texts)]


def test_equal_a_plain_count(spark, rows):
    check(spark, rows)
    check(spark, rows, least=10, percent=20, top=3)


def test_hot_prefixes_small_runs_and_flushes(spark, rows, monkeypatch):
    """Slices for all prefixes, runs that cut phrases, and tasks that pass their cells on often."""
    monkeypatch.setattr(collocations, "HOT", 20)
    monkeypatch.setattr(collocations, "_RUN", 7)
    monkeypatch.setattr(collocations, "_CELLS", 40)
    check(spark, rows[:60])


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12 + 7, 10**12 + 9, 10**12 + 8), (10, 10, 10), (10, 13, 3000)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score("a", "l", "r")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in ((10**12 + 7, 10**12 + 9, 10**12 + 8), (10, 10, 10), (10, 13, 3000))]


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a b")], "doc_id long, lang string, text string")
    assert collocations.collocations(docs.where("false")).count() == 0 and collocations.collocations(docs).count() == 0
