"""Queries that once had row filters, over the larger tables: a cut that only some sizes show is noticed here."""

import duckdb
import pytest
from test_queries import TABLES, order, same

from pluviogrid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
NAMES = ["f15_humidity", "f19_lapse_wind", "f22_wind_rose", "f24_change_gauss", "f27_registry", "j03_outer", "j13_as_of_nearest", "j17_combine_first", "j18_missing_days", "io27_tile_diagnosis", "a06_union", "a07_intersect", "a08_except", "plan_pooled_conditional"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=order)
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=order)
    assert got and len(got) == len(want) and all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_as_of_nearest_between_seconds(spark, tmp_path):
    """Times near a half hour and at the edge of the tolerance, with parts of a second (F3)."""
    at = ["04:30:00.6", "04:30:00.4", "04:30:00.5", "04:30:01.5", "04:29:59.5", "00:59:59.6", "00:59:59.4", "00:59:59.5", "01:00:00", "05:10:10.25"]
    con = duckdb.connect()
    rows = ", ".join([f"({i}, TIMESTAMP '2024-01-01 {t}', 3, 'error', 0.0)" for i, t in enumerate(at)] + [f"({100 + h}, TIMESTAMP '2024-01-01 {h:02}:10:00.123', 3, 'purchase', {h}.5)" for h in range(9)])
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in QUERIES["j13_as_of_nearest"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLE_SQL["j13_as_of_nearest"]).fetchall()) and len(got) == len(at) - 1
