"""The vector index against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import search, vector_index

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, seed, dim=24):
    """Vectors around centres, a third of them around one; some null, zero or broken."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 2
    rows = [(i, (centres[0 if i % 3 == 0 else rng.integers(20)] + rng.normal(size=dim)).tolist()) for i in range(n)]
    rows[7], rows[11], rows[13], rows[200] = (7, None), (11, [0.0] * dim), (13, [1.0] * (dim - 1) + [None]), (200, rows[300][1])
    return rows


def test_recall_and_exact_similarities(spark, tmp_path):
    rows = clustered(6000, 1)
    e = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = vector_index.fit(e, sample=2000)
    index = vector_index.build(e, quantiser, f"{tmp_path}/index")
    assert {r.vec_id for r in index.collect()} == {i for i, v in rows if i not in (7, 11, 13)}
    found = vector_index.nearest(index, quantiser, e, queries, 10, block=25)
    exact = vector_index.nearest(index, quantiser, e, queries, 10, exact=True)
    told = vector_index.recall(found, exact).first()
    assert (told.n_queries, told.n_exact) == (60, 600) and told.recall >= 0.9
    assert quantiser.probes < len(quantiser.centres)
    best = {(r.query_id, r.vec_id): r.similarity for r in search.match_many(queries, e, 6000).collect()}
    got = found.collect()
    assert all(abs(best[r.query_id, r.vec_id] - r.similarity) < 1e-9 and r.query_id != r.vec_id for r in got)
    for q in range(0, 6000, 100):
        own = sorted((r["rank"], -r.similarity, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: r[1:])
    # all lists and all candidates: nothing is lost
    whole = vector_index.nearest(index, quantiser, e, queries, 10, probes=len(quantiser.centres), candidates=600)
    assert vector_index.recall(whole, exact).first().recall == 1.0


def test_search_opens_its_lists_alone(spark, tmp_path):
    e = spark.createDataFrame(clustered(2000, 2), SCHEMA).cache()
    quantiser = vector_index.fit(e)
    index = vector_index.build(e, quantiser, f"{tmp_path}/index")
    one = e.filter("vec_id = 500").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.nearest(index, quantiser, e, one, 3, probes=2)
    assert "PartitionFilters: [list" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3


def test_small_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert vector_index.fit(none) is None and vector_index.fit(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], SCHEMA)) is None
    index = vector_index.build(none, None, f"{tmp_path}/none")
    assert vector_index.nearest(index, None, none, asked, 5).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.5])], SCHEMA)
    quantiser = vector_index.fit(few)
    index = vector_index.build(few, quantiser, f"{tmp_path}/few")
    assert [r.vec_id for r in vector_index.nearest(index, quantiser, few, asked, 5).orderBy("rank").collect()] == [2, 3]
    assert vector_index.nearest(index, quantiser, few, asked.limit(0), 5).count() == 0


def test_fit_is_bounded(spark):
    rng = random.Random(1)
    e = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(3000)], SCHEMA)
    quantiser = vector_index.fit(e, sample=100)
    assert len(quantiser.centres) <= 12 and quantiser.parts.shape[1] <= 100
