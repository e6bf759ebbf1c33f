"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__
from pluviogrid.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def order(row):
    return tuple((v is None, v if isinstance(v, (int, float)) else 0, "" if isinstance(v, (int, float)) else str(v)) for v in row)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2.1e-6)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=order)
    assert got
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=order)
        assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_invariants(spark, sf):
    from pyspark.sql import functions as F

    for name in ("h05_conditional_steps", "h06_conditional_n_wet", "h07_conditional_max"):
        p = QUERIES[name](spark, sf).groupBy("run", "cell", "bin_low").agg(F.sum("p").alias("p"))
        assert p.where("abs(p - 1) > 1e-4").count() == 0
    b = QUERIES["b05_analog_method"](spark, sf)
    assert b.where("abs(mass - total) > 1e-5").count() == 0
    assert QUERIES["b13_bias"](spark, sf).where("mass_error > 1e-5").count() == 0
    s = QUERIES["b02_step_sampler"](spark, sf)
    assert s.where("abs(mass - total) > 1e-5").count() == 0
