"""Every query and stage takes odd rows and empty tables, with a defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm.queries import QUERIES

DOCUMENT_QUERIES = [n for n in QUERIES if n != "op5_chat"]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows(tables, odd, name):
    rows = QUERIES[name](odd.sparkSession, tables()).collect()
    if name not in ("op1_decontamination", "op11_ranked", "op13_audit"):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    twice = [tuple(r) for r in rows if r.doc_id == 5] if name not in ("op11_ranked", "op13_audit") else []
    if name != "op4_fingerprint":  # there the next document of the first copy is the second
        assert len(set(twice)) <= 1


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables(tables, odd, name):
    spark = odd.sparkSession
    folder = tables(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    assert QUERIES[name](spark, folder).count() == 0


def test_stages_take_odd_rows(tables, odd):
    spark = odd.sparkSession
    folder = tables()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        assert out.count() <= odd.count()
    assert stage(spark, odd.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).filter("not exact").count() == 0


def test_stages_take_any_names_and_types(tables, odd):
    """Names that need quoting or meet an operator's own, types without an order."""
    spark = odd.sparkSession
    strange = odd.withColumns({c: F.lit("mine") for c in ("__h1", "__none", "__id", "a.b", "c0", "c5", "row", "with `tick`", "a b")}).withColumn("map", F.create_map(F.lit("k"), F.col("n_chars")))
    folder = tables()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, strange, folder)
        assert out.columns == strange.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in strange.schema], name
        rows = out.collect()
        assert rows and all(r["a.b"] == r["__h1"] == r["__id"] == r["c5"] == r["with `tick`"] == "mine" and r["map"].keys() == {"k"} for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, strange, folder).count() == odd.count()


def test_pipeline_on_odd_and_empty_tables(tables, odd):
    rows = corpus_pipeline.run(odd.sparkSession, tables()).collect()
    kept = [r.doc_id for r in rows]
    assert 1 not in kept and 2 not in kept and 3 not in kept  # no letters
    assert 7 not in kept and 6 in kept  # a copy, case aside
    assert all(r.exact for r in rows)


def test_pipeline_on_empty_tables(tables, odd):
    assert corpus_pipeline.run(odd.sparkSession, tables(odd.limit(0))).count() == 0
