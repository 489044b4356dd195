"""Registered queries run, and those with SQL equal it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"j1_g17_g19_clipped_length", "pipeline"}


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in entry.oracle_sql() and n not in SLOW))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
