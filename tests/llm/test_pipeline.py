import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, linededup, simhash
from leafmill.llm.queries import documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    n, columns = docs.count(), docs.columns
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    assert simhash.classes(docs).where(F.col("doc_id") != F.col("component_id")).count() == 0
    assert decontaminate.contamination(docs, benchmark).where("n_hit > 0").count() == 0
    assert linededup.cuts(docs).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = {tuple(r) for r in last.collect()}
    assert len(rows) == n
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == rows


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 13)] == [1] * 12


def test_stages_take_odd_tables(spark, frame, odd):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    for docs in (frame(odd), frame([])):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).persist()
            assert docs.columns == columns and docs.count() <= n, name
            n = docs.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == n
        assert (n == 0) == (docs.limit(1).count() == 0)
