"""Queries on tables whose part keys pass those that the suppliers' nodes begin with."""

import duckdb
import pytest
from test_entry import NAMES, SF, rows

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    path = tmp_path_factory.mktemp("large")
    for name in NAMES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        shifted = f"replace ({key} + 999950 as {key})" if key else ""
        duckdb.execute(f"copy (select * {shifted} from '{SF}/{name}.parquet') to '{path}/{name}.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["g15_g16_wkt", "j6_tile_edges_induced", "j1_g17_city_segments", "g23_raster"])
def test_equals_sql(spark, large, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{large}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, large)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_nodes_are_distinct(spark, large):
    from roadmesh.plans.inputs import Inputs

    nodes = Inputs(spark, large).nodes()
    assert nodes.count() == nodes.select("node_id").distinct().count()
