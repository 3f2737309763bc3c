"""The corpus pipeline, stage by stage, and the package's registration."""

import corpus_pipeline
from logloom.llm import queries


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and now and docs.count() == len(now)
        ids = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p["doc_id"] for p in pieces} == ids


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert all(used[k] == 2048 for k in list(sorted(used))[:-1])


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
