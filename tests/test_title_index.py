"""The title index against looking at every title."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from brindle.operators import search, title_index
from brindle.plans.registry import ORACLE_SQL, QUERIES


def test_all_terms_against_all_titles(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aAbBé ") for _ in range(rng.randint(1, 7)))
    titles = [(i, f"p{rng.randrange(40)}", rng.choice([word(), word(), "the " + word()])) for i in range(200)] + [(900, "p1", None), (901, "p2", ""), (902, "p3", "ab")]
    terms = [(i, word()[: rng.randint(0, 6)]) for i in range(60)] + [(70, None), (71, "the"), (72, "THE"), (73, "zzz"), (74, "e"), (75, "%"), (76, "ab")]
    t = spark.createDataFrame(titles, "key int, page string, title string").repartition(3)
    asked = spark.createDataFrame(terms, "term_id int, term string")
    index = title_index.postings(t, "key", "title").cache()

    def brute(term, by_page, limit):
        hits = []
        for k, page, title in sorted(titles):
            if term and title and term.lower() in title.lower():
                low = title.lower()
                hits.append((1 if low == term.lower() else 2 if low.startswith(term.lower()) else 3, k, page))
        if by_page:
            first = {}
            for h in sorted(hits, key=lambda h: h[1]):
                first.setdefault(h[2], h)
            hits = list(first.values())
        return [(i + 1, tier, k) for i, (tier, k, _) in enumerate(sorted(hits)[:limit])]

    for page, limit in ((None, None), (None, 3), ("page", 3)):
        got = {}
        for r in title_index.search(index, t, asked, "key", "title", ["key"], limit, page).collect():
            got.setdefault(r.term_id, []).append((r.place, r.tier, r.key))
        assert {k: sorted(v) for k, v in got.items()} == {i: b for i, term in terms if (b := brute(term, page, limit))}


def test_a_page_is_found_by_any_of_its_titles(spark):
    titles = spark.createDataFrame([("d", "Blue", "c"), ("d", "Red", "c"), ("e", "Infrared", "c"), ("e", "Redder", "c"), ("f", "x", "c")], "doc_id string, title string, category string")
    found = spark.createDataFrame([], "chunk_id string, page_id string, doc_id string, title string, similarity double")
    rows = search.hybrid_search(titles, found, titles, "red").orderBy("role", "place").collect()
    assert [(r.role, r.place, r.doc_id, r.title, r.match_type) for r in rows] == [("exact", 1, "d", "Red", "exact"), ("exact", 2, "e", "Infrared", "contains"), ("selected", 0, "d", "Red", "exact")]
    assert title_index.postings(titles.withColumn("key", F.col("title")), "key", "title").filter("key = 'x'").count() == 1


def test_a_term_of_many_titles_and_askers_is_dealt(spark, monkeypatch):
    """The rows of one term do not all come from one task."""
    monkeypatch.setattr(title_index, "RUN", 8)
    titles = spark.range(200).select(F.col("id").alias("key"), F.concat(F.lit("ab"), "id").alias("title"))
    asked = spark.range(50).select(F.col("id").alias("term_id"), F.lit("ab").alias("term"))
    found = title_index.search(title_index.postings(titles, "key", "title"), titles, asked, "key", "title", ["key"], None)
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 10_000 and max(counts) < 6_000
    assert found.filter("term_id = 7").agg(F.countDistinct("place"), F.max("place")).first()[:] == (200, 200)


def test_titles_of_the_same_text_are_one_entry(spark, monkeypatch):
    """The text as key: each of its titles is found, in runs and lists of any size (F1)."""
    monkeypatch.setattr(title_index, "RUN", 2)
    monkeypatch.setattr(title_index, "LIST", 3)
    titles = spark.createDataFrame([(i, ("Red rod", "red rod", "old red", "bolt", None)[i % 5]) for i in range(40)], "key int, title string")
    askers = [*range(7), None, None, 3]
    asked = spark.createDataFrame([(i, "RED") for i in askers] + [(50, "Red Rod"), (51, "ol")], "term_id int, term string")
    index = title_index.postings(titles.select("title").distinct(), "title", "title")
    found = title_index.search(index, titles, asked, "title", "title", ["key"], None).collect()
    rods, olds = [i for i in range(40) if i % 5 < 2], [i for i in range(40) if i % 5 == 2]
    bolts = [i for i in range(40) if i % 5 == 3]
    red = [(p, t, k) for p, (t, k) in enumerate([(2, k) for k in rods] + [(3, k) for k in olds], 1)]
    ol = [(p, t, k) for p, (t, k) in enumerate([(2, k) for k in olds] + [(3, k) for k in bolts], 1)]
    want = [(i, *r) for i in askers for r in red] + [(50, p, 1, k) for p, k in enumerate(rods, 1)] + [(51, *r) for r in ol]
    assert sorted(((r.term_id, r.place, r.tier, r.key) for r in found), key=str) == sorted(want, key=str)


def test_parts_of_one_name_are_not_indexed_each(spark, sf, tmp_path, monkeypatch):
    """s4_title_index on copies: as many entries as names, and the rows of its SQL (F1)."""
    con = duckdb.connect()
    con.execute(f"copy (select p_partkey + 200 * i as p_partkey, p_name from range(5) r(i), '{sf}/part.parquet') to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    indexed, postings = [], title_index.postings
    monkeypatch.setattr(title_index, "postings", lambda titles, *a: indexed.append(titles) or postings(titles, *a))
    df = QUERIES["s4_title_index"](spark, str(tmp_path))
    found = con.execute(ORACLE_SQL["s4_title_index"])
    assert sorted(df.select(*(d[0] for d in found.description)).collect()) == sorted(found.fetchall())
    assert indexed[0].count() == con.execute("select count(distinct p_name) from part").fetchone()[0]
