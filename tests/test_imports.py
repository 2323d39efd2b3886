"""Imports, later runs and batches that are given again."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import imports, mutations
from brindle.sources import schemas

DOC = "doc_id string, url string, url_hash string, title string, category string, resolved_category string, page_state string, is_unresolved boolean, embedding_text string"
CHUNK = "doc_id string, chunk_id string, chunk_index int, title string, category string, is_unresolved boolean, chunk_text string, char_start int, char_end int, embedding array<float>"
NOW, LATER = "2024-01-01", "2024-02-01"


def at(day):
    return F.lit(day).cast("timestamp")


def docs_of(spark, **texts):
    return spark.createDataFrame([(k, f"u/{k}", None, k.upper(), "c", None, "content", False, t) for k, t in texts.items()], DOC)


def chunks_of(spark, vector=None, **texts):
    rows = [(k, f"{k}_chunk_{i:03d}", i, k, "c", False, t, 0, len(t), vector) for k, v in texts.items() for i, t in enumerate(v.split("|"))]
    return spark.createDataFrame(rows, CHUNK)


def empty(spark):
    return tuple(spark.createDataFrame([], schemas.TABLES[t]) for t in ("rule_pages", "rule_chunks"))


def test_rows_have_all_columns_and_their_metadata(spark):
    docs = docs_of(spark, a=" body ").withColumns({"breadcrumbs": F.array(F.lit("x")), "properties": F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("p", "1"), ("q", "2"), ("p", "3")))), "raw_html_path": F.lit(""), "source_item_id": F.lit("7")})
    page = imports.page_rows(docs, at(NOW)).first()
    assert set(page.asDict()) == set(schemas.TABLES["rule_pages"].names)
    assert json.loads(page.metadata) == {"breadcrumbs": ["x"], "crawl_sources": [], "resolution_evidence": [], "properties": {"p": "3", "q": "2"}, "description": "", "extensions": [], "raw_html_path": None, "embedding_text_length": 4}
    assert (page.source_item_id, page.subcategory, page.normalized_content, page.source_snapshot_at) == ("7", None, "body", page.last_seen_at)
    with_vector, without = (imports.chunk_rows(chunks_of(spark, v, a="x"), imports.page_rows(docs, at(NOW)), "m", at(NOW)).first() for v in ([1.0], None))
    assert set(without.asDict()) == set(schemas.TABLES["rule_chunks"].names)
    assert (with_vector.embedding, with_vector.embedding_model, with_vector.embedded_at is not None) == ([1.0], "m", True)
    assert (without.embedding, without.embedding_model, without.embedded_at) == (None, None, None)
    assert json.loads(without.metadata) == {"source_item_id": None, "page_state": None, "resolution_confidence": None, "breadcrumbs": []}


def test_legacy_rows_fail_on_a_chunk_without_document(spark):
    docs = docs_of(spark, a="t").withColumn("resolved_category", F.lit("r"))
    row = imports.legacy_rows(docs, chunks_of(spark, a="x|y")).orderBy("title").first()
    told = json.loads(row.metadata)
    assert (row.title, row.category, told["total_chunks"], told["doc_id"], told["char_end"], told["source_snapshot_at"]) == ("A (part 1/2)", "r", 2, "a", 1, None) and len(told) == 17
    lost = chunks_of(spark, b="x").withColumn("doc_id", F.lit(None).cast("string"))
    for bad in (lost, chunks_of(spark, b="x")):
        with pytest.raises(Exception, match="missing canonical document"):
            imports.legacy_rows(docs, bad).collect()


def test_later_runs(spark, tmp_path):
    """Pages and chunks over three runs, each written by one swap."""

    def run(day, chunk_texts, vector=None):
        held = tuple(mutations.snapshot(spark, str(tmp_path), t, schemas.TABLES[t]) for t in ("rule_pages", "rule_chunks"))
        docs = docs_of(spark, **{k: v.replace("|", " ") for k, v in chunk_texts.items()})
        pages, rows = imports.sync_rules(docs, chunks_of(spark, vector, **chunk_texts), *held, at(day), "m")
        mutations.swap({"rule_pages": pages, "rule_chunks": rows}, str(tmp_path))
        now = [mutations.current(spark, str(tmp_path), t) for t in ("rule_pages", "rule_chunks")]
        return (
            {r.doc_id: (r.version, r.normalized_content, r.deleted_at is not None) for r in now[0].collect()},
            {r.chunk_id[:1] + r.chunk_id[-1]: (r.chunk_text, r.version, r.is_active, r.embedding is not None) for r in now[1].collect()},
            {r.chunk_id[:1] + r.chunk_id[-1] for r in imports.pending_vectors(now[1]).collect()},
        )

    first = run(NOW, {"a": "1|2|3", "b": "x", "c": "y|z"}, [1.0])
    assert first == ({"a": (1, "1 2 3", False), "b": (1, "x", False), "c": (1, "y z", False)}, {"a0": ("1", 1, True, True), "a1": ("2", 1, True, True), "a2": ("3", 1, True, True), "b0": ("x", 1, True, True), "c0": ("y", 1, True, True), "c1": ("z", 1, True, True)}, set())
    second = run(LATER, {"a": "1|9", "c": "y|z", "d": "new"})
    assert second[0] == {"a": (2, "1 9", False), "b": (1, "x", True), "c": (1, "y z", False), "d": (1, "new", False)}
    assert second[1] == {"a0": ("1", 2, True, False), "a1": ("9", 2, True, False), "a2": ("3", 1, False, True), "b0": ("x", 1, False, True), "c0": ("y", 1, True, True), "c1": ("z", 1, True, True), "d0": ("new", 1, True, False)}
    assert second[2] == {"a0", "a1", "d0"}
    # b comes back unchanged with its vector, a's old third chunk stays away, c goes
    third = run(LATER, {"a": "1|9", "b": "x", "d": "new"})
    assert third[0] == {"a": (2, "1 9", False), "b": (1, "x", False), "c": (1, "y z", True), "d": (1, "new", False)}
    assert third[1] == second[1] | {"b0": ("x", 1, True, True), "c0": ("y", 1, False, True), "c1": ("z", 1, False, True)}


def test_a_batch_counts_once(spark, tmp_path):
    """A stream that is cut off after a batch was written, and one that begins anew."""
    folder, source = str(tmp_path / "tables"), str(tmp_path / "in")
    for k, texts in enumerate(({"a": "one", "b": "two"}, {"b": "three", "c": "four"})):
        docs_of(spark, **texts).coalesce(1).write.parquet(f"{source}/{k}")
    calls, dies = [], [True]

    def batch(df, number):
        calls.append((number, imports.import_batch(folder, df, number, at(NOW))))
        if number == 1 and dies:
            dies.pop()
            raise RuntimeError("cut off after the batch was written")

    def stream(name):
        rows = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="cut off"):
        stream("cp").awaitTermination(120)
    held = lambda: (sorted((r.doc_id, r.normalized_content) for r in mutations.current(spark, folder, "rule_pages").collect()), sorted((r.chunk_id, r.chunk_text) for r in mutations.current(spark, folder, "rule_chunks").collect()))
    done, name = held(), (tmp_path / "tables" / "CURRENT").read_text()
    stream("cp").awaitTermination(120)
    stream("other").awaitTermination(120)
    assert [c for c in calls if c[1]] == [(0, True), (1, True)] and len(calls) == 5
    assert held() == done and (tmp_path / "tables" / "CURRENT").read_text() == name
    assert done[0] == [("a", "one"), ("b", "three"), ("c", "four")] and [c for c, _ in done[1]] == ["a_chunk_000", "b_chunk_000", "c_chunk_000"]
    assert mutations.current(spark, folder, "ledger").count() == 2
