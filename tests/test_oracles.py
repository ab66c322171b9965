"""A choice of registered queries against their SQL on DuckDB; the driver compares them all."""

import duckdb
import pytest

from framelake.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
CHOSEN = ["b1_rgb8_to_y8", "b4_to_y8", "c3_rotate90", "c7_resize_nearest", "d2_box_direct", "d9_median_quadrant", "d14_adaptive_threshold", "e6_match_map", "e4_equalise_drift", "f1_average", "f3_beat", "f6_deinterlace_interframe", "f8_background_mean", "f10_persistent", "f16_stabilise", "f20_track_position", "g3_fuse", "g4_multiplex", "h2_components", "a7_stack_pages"]


def plain(value):
    return f"{value:.8g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = found.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in expected)
    assert rows
