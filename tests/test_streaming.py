import datetime as dt

from pluviogrid.streaming.streams import resample_stream, spell_stream


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2001, 1, 1)
    rows = [(0, t0 + dt.timedelta(hours=h), float(v)) for h, v in enumerate([2, 2, 0, 3, 0, 0, 1, 1, 1, 0])] + [(0, t0 + dt.timedelta(days=3), 9.0)]
    batch = spark.createDataFrame(rows, "cell int, ts timestamp, value double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f, want in (("hours", resample_stream, 10), ("spells", spell_stream, 3)):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        q = f(stream, ["cell"]).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
    assert sorted((r.duration, r.total) for r in spark.table("spells").collect()) == [(1, 3.0), (2, 4.0), (3, 3.0)]
