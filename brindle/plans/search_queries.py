"""Search, ranking and set queries over embeddings and part."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.operators import search, title_index, vector_index
from brindle.plans.base import query, shared_folder, table


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: the embedding of least id."""
    row = table(spark, sf_dir, "embeddings").select("embedding", "vec_id").orderBy("vec_id").limit(1).collect()
    return [float(x) for x in row[0]["embedding"]] if row else [0.0]


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
SIM = f"list_cosine_similarity(embedding::DOUBLE[], {Q0})"


@query("s1_semantic_topk", f"SELECT vec_id, label, round({SIM}, 6) AS similarity FROM embeddings WHERE {SIM} >= 0.3 ORDER BY {SIM} DESC, vec_id LIMIT 10")
def s1_semantic_topk(spark, sf_dir):
    found = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.3, 10)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("s1_semantic_filtered", f"SELECT vec_id, label, round({SIM}, 6) AS similarity FROM embeddings WHERE label = 1 AND {SIM} >= 0.05 ORDER BY {SIM} DESC, vec_id LIMIT 20")
def s1_semantic_filtered(spark, sf_dir):
    found = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.05, 20, category=1)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    "s2_search_over_fetch",
    f"SELECT vec_id, round({SIM}, 6) AS similarity FROM (SELECT * FROM embeddings WHERE {SIM} >= 0.1 ORDER BY {SIM} DESC, vec_id LIMIT 9) ORDER BY {SIM} DESC, vec_id LIMIT 3",
)
def s2_search_over_fetch(spark, sf_dir):
    found = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.1, search.over_fetch(3))
    return found.orderBy(F.desc("similarity"), "vec_id").limit(3).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "d8_multi_query_topk",
    """SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON e.vec_id <> q.vec_id) WHERE rank <= 3""",
)
def d8_multi_query_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.match_many(queries, e, 3).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(
    "f1_dedupe_best_per_page",
    f"SELECT label, vec_id, round(s, 6) AS similarity FROM (SELECT label, vec_id, {SIM} AS s FROM embeddings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1",
)
def f1_dedupe_best_per_page(spark, sf_dir):
    found = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), -2.0, None)
    return search.best_per_page(found, "label", "similarity", "vec_id").select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "f1_slice_then_dedupe",
    f"WITH t AS (SELECT label, vec_id, {SIM} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 6) SELECT label, vec_id, round(s, 6) AS similarity FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1",
)
def f1_slice_then_dedupe(spark, sf_dir):
    found = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), -2.0, 6)
    return search.best_per_page(found, "label", "similarity", "vec_id").select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


TIER = "CASE WHEN lower(p_name) = 'red' THEN 1 WHEN starts_with(lower(p_name), 'red') THEN 2 ELSE 3 END"


@query("f2_title_rank", f"SELECT p_partkey, p_name, {TIER} AS tier FROM part WHERE contains(lower(p_name), 'red') ORDER BY tier, p_partkey LIMIT 20")
def f2_title_rank(spark, sf_dir):
    return search.rank_titles(table(spark, sf_dir, "part"), "p_name", "Red", "p_partkey", 20).select("p_partkey", "p_name", "tier")


@query("s3_by_category", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' ORDER BY p_name, p_partkey LIMIT 10")
def s3_by_category(spark, sf_dir):
    return search.by_category(table(spark, sf_dir, "part"), "p_brand", "Brand#2", ["p_name", "p_partkey"], 10).select("p_partkey", "p_name")


@query("s4_title_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' ORDER BY p_partkey LIMIT 1")
def s4_title_ilike(spark, sf_dir):
    return search.first_ilike(table(spark, sf_dir, "part"), "p_name", "WIDGET", "p_partkey").select("p_partkey", "p_name")


@query("s5_titles", "SELECT p_partkey, p_name, lower(p_name) AS p_key, p_brand FROM part")
def s5_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_name").alias("p_key"), "p_brand")


@query(
    "s6_hybrid_merge",
    f"""WITH x AS (SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'red' THEN 1 WHEN starts_with(lower(p_name), 'red') THEN 2 ELSE 3 END AS tier FROM part WHERE contains(lower(p_name), 'red') ORDER BY tier, id LIMIT 3),
 s AS (SELECT vec_id AS id, {SIM} AS s FROM embeddings WHERE {SIM} >= 0.1 ORDER BY s DESC, id LIMIT 12)
SELECT id, tier, NULL::DOUBLE AS similarity, 'exact' AS source FROM x UNION ALL SELECT id, NULL, round(s, 6), 'semantic' FROM s WHERE id NOT IN (SELECT id FROM x)""",
)
def s6_hybrid_merge(spark, sf_dir):
    exact = search.rank_titles(table(spark, sf_dir, "part"), "p_name", "red", "p_partkey", 3).select(F.col("p_partkey").alias("id"), "tier", F.lit(None).cast("double").alias("similarity"))
    semantic = search.match_chunks(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.1, 12).select(F.col("vec_id").alias("id"), F.lit(None).cast("int").alias("tier"), F.round("similarity", 6).alias("similarity"))
    return search.hybrid(exact, semantic, "id")


@query("g4_autocomplete", "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY p_name LIMIT 25")
def g4_autocomplete(spark, sf_dir):
    return search.autocomplete(table(spark, sf_dir, "part"), "p_name", "BOLT")


@query("g5_prefix_autocomplete", "SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 'blue') ORDER BY p_name LIMIT 25")
def g5_prefix_autocomplete(spark, sf_dir):
    return search.autocomplete(table(spark, sf_dir, "part"), "p_name", "blue", prefix=True)


@query(
    "h4_two_way_diff",
    """SELECT p_type, 'add' AS side FROM (SELECT p_type FROM part WHERE p_size > 49 EXCEPT SELECT p_type FROM part WHERE p_brand = 'Brand#3' AND p_size < 2)
UNION ALL SELECT p_type, 'remove' FROM (SELECT p_type FROM part WHERE p_brand = 'Brand#3' AND p_size < 2 EXCEPT SELECT p_type FROM part WHERE p_size > 49)""",
)
def h4_two_way_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    want, have = p.filter("p_size > 49").select("p_type").distinct(), p.filter("p_brand = 'Brand#3' and p_size < 2").select("p_type").distinct()
    add, remove = want.join(have, "p_type", "left_anti"), have.join(want, "p_type", "left_anti")
    return add.withColumn("side", F.lit("add")).unionByName(remove.withColumn("side", F.lit("remove")))


@query("d10_cross_seed", "SELECT r_regionkey, n_nationkey, 0 AS ftw FROM region CROSS JOIN nation")
def d10_cross_seed(spark, sf_dir):
    """Every new owner with every entry of a fixed catalogue, as seeding needs."""
    return table(spark, sf_dir, "region").select("r_regionkey").crossJoin(table(spark, sf_dir, "nation").select("n_nationkey")).withColumn("ftw", F.lit(0))


def _indexed(spark, sf_dir):
    """(found, exact): the ten nearest by the index and by comparing all, of every vector
    whose number 100 divides."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = vector_index.fit(e)
    index = vector_index.build(e, quantiser, f"{shared_folder(spark)}/index")
    return vector_index.nearest(index, quantiser, e, queries, 10), vector_index.nearest(index, quantiser, e, queries, 10, exact=True), index


@query("s1_index_topk")
def s1_index_topk(spark, sf_dir):
    """By the index: nearly all of the exact neighbours, with their exact similarity."""
    found, _, _ = _indexed(spark, sf_dir)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("s1_index_recall", "SELECT (SELECT count(*) FROM embeddings) AS n_indexed, count(*) AS n_queries, count(*) * 10 AS n_exact, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def s1_index_recall(spark, sf_dir):
    """Every vector is in the index, and nine tenths of the exact neighbours are found."""
    found, exact, index = _indexed(spark, sf_dir)
    told = vector_index.recall(found, exact)
    return told.join(index.agg(F.count("*").alias("n_indexed"))).select("n_indexed", "n_queries", "n_exact", (F.col("recall") >= 0.9).alias("reached"))


TERMS = "SELECT p_partkey AS term_id, CASE p_partkey % 300 WHEN 0 THEN upper(p_name) WHEN 100 THEN substring(p_name, 2, 6) ELSE substring(p_name, 1, 2) END AS term FROM part WHERE p_partkey % 100 = 0"


@query(
    "s4_title_index",
    f"SELECT term_id, row_number() OVER (PARTITION BY term_id ORDER BY tier, p_partkey) AS place, tier, p_partkey, p_name FROM (SELECT term_id, p_partkey, p_name, CASE WHEN lower(p_name) = lower(term) THEN 1 WHEN starts_with(lower(p_name), lower(term)) THEN 2 ELSE 3 END AS tier FROM part JOIN ({TERMS}) t ON contains(lower(p_name), lower(term)))",
)
def s4_title_index(spark, sf_dir):
    """Whole names, middles and beginnings of two characters, looked up among all names;
    parts of the same name are one entry of the index."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    terms = spark.sql(TERMS.replace("FROM part", "FROM {p}"), p=p)
    names = p.select("p_name").distinct()
    found = title_index.search(title_index.postings(names, "p_name", "p_name"), p, terms, "p_name", "p_name", ["p_partkey"], None)
    return found.withColumn("place", F.col("place").cast("long"))
