import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviogrid.functions import physics
from pluviogrid.model import nullify
from pluviogrid.sources import tables
from pluviogrid.sources.zarr import is_consolidated, register, write_zarr


def test_station_files(spark, tmp_path):
    text = "INDICATIVO;NOMBRE;NOM_PROV;ALTITUD;LONGITUD;LATITUD;ANO;MES;DIA;PMAX10;PMAX60;P24\nB228;PALMA, SÓLLER;BALEARES;3;0237371;393324;2001;2;3;12;40;x\nB228;PALMA, SÓLLER;BALEARES;3;0237371;393324;2000;12;31;;10;100\nZ1;NORD;LUGO;400;0712002;430000;2001;2;30;1;2;3\n"
    (tmp_path / "a.txt").write_bytes(text.encode("latin-1"))
    rec = tables.station_records(tables.read_semicolon(spark, str(tmp_path / "a.txt")))
    rows = {(r.code, r.day): r for r in rec.collect()}
    r = rows["B228", dt.date(2001, 2, 3)]
    assert (r.name, r.pmax10, r.p24, r.lon, r.lat) == ("PALMA, SÓLLER", 1.2, None, round(2 + 37 / 60 + 37 / 3600, 3), round(39 + 33 / 60 + 24 / 3600, 3))
    assert rows["Z1", None].lon == -round(7 + 12 / 60, 3)
    s = {r.code: r for r in tables.stations(rec).collect()}
    assert s["B228"].sdate == dt.date(2000, 12, 31) and s["B228"].edate == dt.date(2001, 2, 3)


def test_network_and_skipped_lines(spark, tmp_path):
    (tmp_path / "n.txt").write_text("#Code DateTime Prec\nA 2001-01-01_00:10:00 1.5\nA 2001-01-01_00:20:00 -999.0\n")
    rows = tables.read_network(spark, str(tmp_path / "n.txt")).collect()
    assert [r.rain for r in rows] == [1.5, None] and rows[0].ts == dt.datetime(2001, 1, 1, 0, 10)
    (tmp_path / "s.csv").write_text("head\nmore\n2001,1,2,3,0.5\n2001,1,2,4,\n")
    raw = tables.read_skipping(spark, str(tmp_path / "s.csv"), 2, ["year", "month", "day", "hour", "pr"])
    got = tables.hourly_series(raw).collect()
    assert [(r.ts, r.rain) for r in got] == [(dt.datetime(2001, 1, 2, 3), 0.5), (dt.datetime(2001, 1, 2, 4), None)]


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"fecha": "2001-01-02", "indicativo": "X", "nombre": "n", "provincia": "p", "prec": "1,5"}, {"fecha": "2001-01-03", "indicativo": "X", "nombre": "n", "provincia": "p", "prec": "Ip"}, {"fecha": "2001-01-04", "indicativo": "X", "nombre": "n", "provincia": "p", "prec": "Acum"}]')
    rec = tables.climatology_records(tables.read_catalogue(spark, str(tmp_path / "c.json")))
    assert [r.rain for r in rec.orderBy("day").collect()] == [1.5, 0.0, None]
    tables.write_records(rec, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_cube_round_trip(spark, tmp_path):
    cube = spark.createDataFrame([(r, y, x, dt.datetime(2001, 1, 1, h), float(y * x + h)) for r in ("present", "future") for y in range(4) for x in range(4) for h in range(3)], "run string, y int, x int, ts timestamp_ntz, value double")
    path = str(tmp_path / "cube")
    tables.write_cube(cube, path, tile=2, attributes={"units": "mm"})
    back = spark.read.parquet(path)
    assert back.count() == cube.count() and back.select("ty", "tx").distinct().count() == 4
    assert tables.read_attributes(spark, path).first().value == "mm"
    tables.write_cube(cube.limit(1), path, tile=2)
    assert spark.read.parquet(path).count() == cube.count()
    b = tables.with_bounds(cube, 60).first()
    assert b.ts_to - b.ts_from == dt.timedelta(hours=1)


def test_nullify(spark):
    df = spark.createDataFrame([(1.0,), (1e20,), (-999.0,), (float("nan"),), (None,)], "v double")
    assert nullify(df, "v").where("v is not null").count() == 1


@pytest.mark.parametrize("consolidated", [True, False])
def test_zarr(spark, tmp_path, consolidated):
    path = str(tmp_path / "c.zarr")
    rng = np.random.default_rng(0)
    data = rng.random((7, 5, 4)).astype(np.float32)
    rows = [(t, y, x, float(data[t, y, x])) for t in range(7) for y in range(5) for x in range(4) if (t, y, x) != (1, 1, 1)]
    write_zarr(spark.createDataFrame(rows, "time int, y int, x int, value double"), path, "RAIN", ["time", "y", "x"], [7, 5, 4], [3, 2, 4], consolidated=consolidated)
    assert is_consolidated(path) == consolidated
    register(spark)
    df = spark.read.format("zarr").option("path", path).option("variable", "RAIN").load()
    got = {(r.time, r.y, r.x): r.value for r in df.collect()}
    assert len(got) == 140 and got[1, 1, 1] is None and all(got[t, y, x] == pytest.approx(v) for t, y, x, v in rows)
    assert df.where("time = 6 and y >= 4").count() == 4


def test_nice_scale():
    assert physics.nice_scale(0.3, 9.7) == (0.0, 10.0, 1.0)
    with pytest.raises(ValueError):
        physics.nice_scale(1, 1)


def test_unknown_variable(spark):
    with pytest.raises(KeyError):
        physics.compute(spark.range(1).withColumn("a", F.lit(1)), "NOPE")
