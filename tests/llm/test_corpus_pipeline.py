import corpus_pipeline
import __spark_entry__
from pluviogrid.llm import decontamination, minhash_dedup
from pluviogrid.llm.common import table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, seen = table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        rows = out.collect()
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in rows}
        assert after <= before and rows
        seen.append((name, len(before - after)))
        docs = spark.createDataFrame(rows, out.schema)
        if name == "minhash_dedup":
            assert all(r.kept for r in minhash_dedup.near_duplicates(docs, 80).collect())
        if name == "decontamination":
            assert decontamination.find_leaks(docs, table(spark, sf, "benchmark")).count() == 0
    assert [n for n, _ in seen] == ["toxicity", "minhash_dedup", "decontamination", "mixing", "sharding"]
    assert all(gone > 0 for n, gone in seen[1:4])


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_mixing_oracle(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    from pluviogrid.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op6_mixing"])
    want = sorted(rel.fetchall())
    got = sorted(tuple(r[c] for c in rel.columns) for r in queries.QUERIES["op6_mixing"](spark, sf).collect())
    assert got == want


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"shard", "slot", "size"} <= set(out.columns) and out.count() > 0
