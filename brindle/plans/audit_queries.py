"""The audit, canonical documents, imports and page queries.

The crawl's tables do not exist among the driver's, so they are derived from documents
by arithmetic on the id: a page index, the records emitted (some twice, some in a wrong
file), what was completed and what failed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import addresses, html, pages, text
from brindle.operators import audit, chunks, crawl, imports, mutations
from brindle.plans.base import query, shared_folder, table
from brindle.plans.corpus_queries import HEADING
from brindle.sources import schemas

INDEX = """SELECT *, 0 AS position FROM (SELECT 'u' || doc_id AS url, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '' ELSE 'unresolved' END AS category, CASE WHEN doc_id % 7 = 0 THEN 'en' END AS provisional_category,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'crawl_only' ELSE lang END AS resolved_category, CASE doc_id % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'crawl_only' ELSE 'content' END AS page_state,
 CASE WHEN doc_id % 2 = 0 THEN 'high' END AS resolution_confidence, 'p/' || doc_id AS filepath, lang, source, doc_id FROM documents WHERE doc_id % 6 <> 0)
 UNION ALL SELECT 'u' || doc_id, 'de', CAST(NULL AS VARCHAR(9)), 'fr', CASE WHEN doc_id % 2 = 0 THEN 'content' ELSE 'crawl_only' END, 'low', 'q/' || doc_id, lang, source, doc_id, 1 FROM documents WHERE doc_id % 17 = 0 AND doc_id % 6 <> 0"""
EMITTED = """SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 9 = 0 THEN 'unresolved' WHEN doc_id % 10 = 0 THEN 'fr' ELSE lang END AS category, 0 AS file_order, source, "text" AS description FROM documents WHERE doc_id % 4 <> 1
 UNION ALL SELECT 'u' || doc_id, 'de', 1, source || '!', 'again' FROM documents WHERE doc_id % 11 = 0"""
DONE = "SELECT 'u' || doc_id AS url FROM documents WHERE doc_id % 8 <> 3"
FAILED = "SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'status 404 x' ELSE 'http_500' END AS error FROM documents WHERE doc_id % 13 = 0"


def _spark(sql: str) -> str:
    return sql.replace('"text"', "`text`")


def _tables(spark, sf_dir):
    docs = {"documents": table(spark, sf_dir, "documents")}
    none = F.array().cast("array<string>")
    run = lambda sql: spark.sql(_spark(sql).replace("FROM documents", "FROM {documents}"), **docs)
    index = run(INDEX).select("url", "category", "provisional_category", "resolved_category", "page_state", F.array("lang", "source").alias("crawl_sources"), "resolution_confidence", F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("resolution_evidence"), "filepath", "position")
    item = F.struct(
        F.lit("i").alias("id"), F.col("source").alias("name"), "category", F.array("source").alias("breadcrumbs"), F.lit(None).cast("string").alias("subcategory"),
        F.array(F.struct(F.lit("len").alias("k"), F.char_length("description").cast("string").alias("v"))).alias("properties"), "description",
        F.array().cast("array<struct<name:string,description:string>>").alias("extensions"), F.lit("medium").alias("resolution_confidence"), none.alias("resolution_evidence"),
    )
    emitted = run(EMITTED).select("url", "category", "file_order", item.alias("item"))
    return index, emitted, run(DONE), run(FAILED)


WITH = f"WITH idx AS ({INDEX}), emi AS ({EMITTED}), done AS ({DONE}), fail AS ({FAILED}), exp AS (SELECT * FROM idx WHERE page_state IN ('content', 'hybrid') AND coalesce(resolved_category, '') <> 'crawl_only' QUALIFY row_number() OVER (PARTITION BY url ORDER BY position DESC) = 1),"
GROUPED = "em AS (SELECT url, list_sort(list_distinct(list(category))) AS cats, count(*) AS n, arg_min(source, (file_order, category)) AS name, arg_min(description, (file_order, category)) AS description, arg_min(category, (file_order, category)) AS first_category FROM emi GROUP BY url),"
INVENTORY = f"""{WITH} {GROUPED} keys AS (SELECT url FROM exp UNION SELECT url FROM em UNION SELECT url FROM done UNION SELECT url FROM fail),
inv AS (SELECT k.url, sha256(k.url) AS url_hash, 'doc_' || left(sha256(k.url), 16) AS doc_id, true AS discovered, (exp.url IS NOT NULL OR em.url IS NOT NULL OR done.url IS NOT NULL) AS fetched, em.url IS NOT NULL AS parsed,
 (em.url IS NOT NULL AND NOT list_contains(cats, 'unresolved')) AS resolved, em.url IS NOT NULL AS emitted, CASE WHEN error = 'status 404 x' THEN 404 END AS http_status, error AS fetch_error, page_state,
 CASE WHEN exp.url IS NULL THEN '' ELSE lang || '|' || exp.source END AS crawl_sources, provisional_category, coalesce(resolved_category, CASE WHEN cats[1] <> 'unresolved' THEN cats[1] END) AS resolved_category,
 coalesce(resolution_confidence, CASE WHEN em.url IS NOT NULL THEN 'medium' END) AS resolution_confidence, CASE WHEN exp.doc_id % 2 = 0 THEN exp.source ELSE '' END AS resolution_evidence, name AS title, coalesce(name, '') AS breadcrumbs,
 filepath AS raw_html_path, length(trim(coalesce(description, '')))::INTEGER AS text_length, coalesce(n > 1, false) AS is_duplicate, array_to_string(coalesce(cats, []), '|') AS emitted_categories
 FROM keys k LEFT JOIN exp ON exp.url = k.url LEFT JOIN em ON em.url = k.url LEFT JOIN done ON done.url = k.url LEFT JOIN fail ON fail.url = k.url)"""


def _inventory(spark, sf_dir):
    index, emitted, done, failed = _tables(spark, sf_dir)
    return audit.url_inventory(index, emitted, done, failed, F.lit("run-1"))


@query("x17_url_inventory", f"{INVENTORY} SELECT * FROM inv")
def x17_url_inventory(spark, sf_dir):
    found = _inventory(spark, sf_dir)
    joined = {c: F.array_join(c, "|") for c in ("crawl_sources", "resolution_evidence", "breadcrumbs", "emitted_categories")}
    return found.withColumns(joined).drop("url_normalized", "parse_error", "source_urls", "content_hash", "duplicate_of", "run_id", "subcategory")


@query("e2_coverage_totals", f"{INVENTORY} SELECT count(*) AS total, count_if(discovered) AS discovered, count_if(fetched) AS fetched, count(*) FILTER (WHERE fetch_error <> '') AS failed, count_if(parsed) AS parsed, count_if(resolved) AS resolved, count_if(parsed AND NOT resolved) AS unresolved, count_if(emitted) AS emitted, count_if(is_duplicate) AS duplicates FROM inv")
def e2_coverage_totals(spark, sf_dir):
    return audit.coverage_totals(_inventory(spark, sf_dir))


@query("e3_category_coverage", f"{INVENTORY} SELECT coalesce(resolved_category, provisional_category, 'unresolved') AS category, count_if(discovered) AS discovered, count_if(fetched) AS fetched, count_if(parsed) AS parsed, count_if(resolved) AS resolved, count_if(emitted) AS emitted, count(*) FILTER (WHERE fetch_error <> '') AS failed, count_if(emitted AND text_length < 80) AS thin_content FROM inv GROUP BY 1")
def e3_category_coverage(spark, sf_dir):
    return audit.category_coverage(_inventory(spark, sf_dir))


@query("e18_thin_report", f"{INVENTORY} SELECT url, title, resolved_category, text_length, 'thin_content' AS reason FROM inv WHERE emitted AND text_length < 80")
def e18_thin_report(spark, sf_dir):
    return audit.thin_content(_inventory(spark, sf_dir))


@query("x19_discovery_gaps", f"{INVENTORY} SELECT url, 'completed_without_page_index' AS reason FROM done WHERE url NOT IN (SELECT url FROM idx) UNION ALL SELECT url, 'parseable_not_emitted' FROM inv WHERE fetched AND NOT parsed AND page_state IN ('content', 'hybrid')")
def x19_discovery_gaps(spark, sf_dir):
    index, _, done, _ = _tables(spark, sf_dir)
    return audit.discovery_gaps(_inventory(spark, sf_dir), done, index)


FR = "(resolved_category = 'fr' OR provisional_category = 'fr' OR category = 'fr' OR lang = 'fr' OR source = 'fr')"


@query("x19_expected_and_emitted", f"{WITH} hit AS (SELECT * FROM (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY url ORDER BY position DESC) = 1) WHERE {FR}), e AS (SELECT DISTINCT url FROM idx WHERE page_state IN ('content', 'hybrid') AND coalesce(resolved_category, '') <> 'crawl_only' AND {FR}), m AS (SELECT url FROM emi WHERE category = 'fr' OR (category = 'unresolved' AND url IN (SELECT url FROM hit))) SELECT 'expected' AS side, count(*) AS n FROM e UNION ALL SELECT 'emitted', count(*) FROM m")
def x19_expected_and_emitted(spark, sf_dir):
    index, emitted, _, _ = _tables(spark, sf_dir)
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side(audit.expected(index, ["fr"]), "expected").union(side(audit.emitted_rows(emitted, index, ["fr"]), "emitted"))


REPORT = f"""{WITH} {GROUPED} j AS (SELECT coalesce(exp.url, em.url) AS url, exp.url IS NOT NULL AS has, em.url IS NOT NULL AS made, cats,
 CASE WHEN coalesce(resolved_category, '') <> '' THEN resolved_category WHEN coalesce(category, '') <> '' THEN category ELSE 'unresolved' END AS eff,
 CASE WHEN coalesce(resolved_category, '') <> '' OR category NOT IN ('', 'unresolved') THEN list_filter([nullif(resolved_category, ''), CASE WHEN category <> 'unresolved' THEN nullif(category, '') END], lambda x: x IS NOT NULL) ELSE [lang, source] END AS allowed
 FROM exp FULL JOIN (SELECT url, cats FROM em) em ON exp.url = em.url),
a AS (SELECT 'hard' AS severity, 'missing_from_json' AS type, url FROM j WHERE NOT made UNION ALL SELECT 'hard', 'orphan_json', url FROM j WHERE NOT has
 UNION ALL SELECT 'hard', 'duplicate_url_across_files', url FROM j WHERE has AND made AND len(cats) > 1
 UNION ALL SELECT 'hard', 'category_mismatch', url FROM j WHERE has AND made AND cats[1] <> 'unresolved' AND len(allowed) > 0 AND NOT list_contains(allowed, cats[1])
 UNION ALL SELECT 'warn', 'unresolved_items', url FROM j WHERE has AND made AND cats[1] = 'unresolved'
 UNION ALL SELECT 'warn', 'completed_without_page_index', url FROM done WHERE url NOT IN (SELECT url FROM idx))"""


@query("x18_audit_details", f"{REPORT} SELECT severity, type, url FROM a")
def x18_audit_details(spark, sf_dir):
    index, emitted, done, _ = _tables(spark, sf_dir)
    return audit.audit_details(index, emitted, done).select("severity", "type", "url")


@query("e19_anomaly_histogram", f"{REPORT} SELECT severity, type, count(*) AS n FROM a GROUP BY 1, 2")
def e19_anomaly_histogram(spark, sf_dir):
    index, emitted, done, _ = _tables(spark, sf_dir)
    return audit.audit_details(index, emitted, done).groupBy("severity", "type").agg(F.count("*").alias("n"))


@query("e15_seeded_counts", f"{WITH} k(category) AS (VALUES ('en'), ('fr'), ('src0'), ('never')) SELECT k.category, count(u.url) AS n FROM k LEFT JOIN (SELECT url, unnest([lang, source]) AS category FROM exp) u ON u.category = k.category GROUP BY 1")
def e15_seeded_counts(spark, sf_dir):
    index, _, _, _ = _tables(spark, sf_dir)
    keys = spark.createDataFrame([("en",), ("fr",), ("src0",), ("never",)], "category string")
    return audit.counts_of(audit.expected(index), "crawl_sources", keys, "category")


CANON = f"""{INVENTORY}, c AS (SELECT doc_id, i.url, i.page_state, i.resolution_confidence, i.crawl_sources, i.resolution_evidence, i.raw_html_path, em.name, em.description, title, em.first_category AS category, resolved_category, (em.first_category = 'unresolved' OR coalesce(resolved_category, '') = '') AS is_unresolved,
 array_to_string(list_filter(['Title: ' || nullif(name, ''), 'Category: ' || em.first_category, 'Breadcrumbs: ' || name, 'Properties:' || chr(10) || 'len: ' || length(em.description), 'Description:' || chr(10) || nullif(regexp_replace(em.description, '^[\\x20\\t\\n\\r\\f\\x0B]+|[\\x20\\t\\n\\r\\f\\x0B]+$', '', 'g'), '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS embedding_text
 FROM inv i JOIN em ON em.url = i.url)"""


@query("t4_canonical_docs", f"{CANON} SELECT doc_id, url, title, category, resolved_category, is_unresolved, sha256(embedding_text) AS text_sha256, length(embedding_text)::INTEGER AS embedding_text_length, true AS embeddable, NULL::VARCHAR AS exclude_reason FROM c")
def t4_canonical_docs(spark, sf_dir):
    return _canonical(spark, sf_dir).select("doc_id", "url", "title", "category", "resolved_category", "is_unresolved", text.sha256(F.col("embedding_text")).alias("text_sha256"), "embedding_text_length", "embeddable", "exclude_reason")


def _canonical(spark, sf_dir):
    _, emitted, _, _ = _tables(spark, sf_dir)
    return chunks.canonical_documents(_inventory(spark, sf_dir), emitted)


@query("t4_canonical_by_category", f"{CANON} SELECT category, count(*) AS n, count_if(is_unresolved) AS unresolved FROM c WHERE category IN ('fr', 'unresolved') GROUP BY 1")
def t4_canonical_by_category(spark, sf_dir):
    """Of one category; unresolved documents always stay."""
    _, emitted, _, _ = _tables(spark, sf_dir)
    found = chunks.canonical_documents(_inventory(spark, sf_dir), emitted, ["fr"])
    return found.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_unresolved").alias("unresolved"))


@query(
    "c14_exclude_reason",
    """SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 2 = 0 THEN source ELSE ' ' END) = '' AND trim(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END) = '' AND doc_id % 5 <> 0 THEN 'no_informational_text' END AS exclude_reason FROM documents""",
)
def c14_exclude_reason(spark, sf_dir):
    part = lambda k, c, other: F.when(F.col("doc_id") % k == 0, F.col(c)).otherwise(other)
    crumbs = F.when(F.col("doc_id") % 5 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    none = F.lit("")
    return table(spark, sf_dir, "documents").select("doc_id", chunks.exclude_reason(part(2, "source", " "), crumbs, none, part(3, "lang", ""), none).alias("exclude_reason"))


LISTED = lambda c: f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '|') END"
METADATA = f"json_object('breadcrumbs', [name], 'crawl_sources', {LISTED('crawl_sources')}, 'resolution_evidence', {LISTED('resolution_evidence')}, 'properties', json_object('len', length(description)::VARCHAR), 'description', description, 'extensions', [], 'raw_html_path', raw_html_path, 'embedding_text_length', length(embedding_text))"
PAGE_ROWS = f"""{CANON}, p AS (SELECT sha256(doc_id) AS id, doc_id, 'i' AS source_item_id, url AS source_url, sha256(url) AS url_hash, doc_id AS canonical_slug, title, category, resolved_category, page_state, is_unresolved, resolution_confidence,
 sha256(embedding_text) AS content_hash, 'export_embeddings_v1' AS parser_version, 1 AS version, sha256({METADATA}::VARCHAR) AS metadata_sha256 FROM c)"""
PAGE_COLUMNS = ["id", "doc_id", "source_item_id", "source_url", "url_hash", "canonical_slug", "title", "category", "resolved_category", "page_state", "is_unresolved", "resolution_confidence", "content_hash", "parser_version", "version"]


@query("p11_import_pages", f"{PAGE_ROWS} SELECT * FROM p WHERE NOT is_unresolved UNION ALL SELECT 'old', 'doc_old', NULL, 'u', NULL, 's', 't', 'c', NULL, NULL, false, NULL, 'h', NULL, 7, sha256('{{}}')")
def p11_import_pages(spark, sf_dir):
    """The structured import into a table with one page of its own and one it replaces."""
    docs = _canonical(spark, sf_dir)
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], schemas.TABLES["rule_pages"])
    own = spark.createDataFrame([("old", "doc_old", "u", "s", "t", "c", False, "h", 7, "{}")], "id string, doc_id string, source_url string, canonical_slug string, title string, category string, is_unresolved boolean, content_hash string, version int, metadata string")
    kept = docs.filter("not is_unresolved")
    stale = imports.page_rows(kept.orderBy("doc_id").limit(1), now).withColumn("title", F.lit("stale"))
    held = empty.unionByName(own, allowMissingColumns=True).unionByName(stale)
    none = spark.createDataFrame([], "doc_id string, chunk_id string, chunk_index int, title string, category string, chunk_text string, char_start int, char_end int, is_unresolved boolean")
    pages, _ = imports.import_structured(kept, none, held, spark.createDataFrame([], schemas.TABLES["rule_chunks"]), now)
    return pages.select(*PAGE_COLUMNS, text.sha256(F.col("metadata")).alias("metadata_sha256"))


CHUNK_META = "json_object('source_item_id', 'i', 'page_state', page_state, 'resolution_confidence', resolution_confidence, 'breadcrumbs', [name])"


@query(
    "p11_import_chunks",
    f"""{CANON} SELECT doc_id || '_chunk_' || lpad(i::VARCHAR, 3, '0') AS chunk_id, sha256(doc_id) AS page_id, i AS chunk_index, category, resolved_category, sha256(trim(substring(embedding_text, (i * 1200 + 1)::BIGINT, 1400))) AS text_sha256, sha256({CHUNK_META}::VARCHAR) AS metadata_sha256, CASE WHEN i % 2 = 0 THEN 'model-1' END AS embedding_model, CASE WHEN i % 2 = 0 THEN i + 0.5 END::DOUBLE AS first_number
FROM (SELECT *, unnest(range(CASE WHEN length(embedding_text) <= 1400 THEN 1 ELSE ceil((length(embedding_text) - 1400) / 1200.0)::BIGINT + 1 END)) AS i FROM c)""",
)
def p11_import_chunks(spark, sf_dir):
    """Chunks of hard splits, each with its page's id; every other one has a vector."""
    docs = _canonical(spark, sf_dir)
    cut = docs.select("doc_id", "title", "category", "resolved_category", "is_unresolved", "source_item_id", "page_state", "resolution_confidence", "breadcrumbs", F.posexplode(chunks.hard_split(F.col("embedding_text"))).alias("chunk_index", "c"))
    vector = F.when(F.col("chunk_index") % 2 == 0, F.array(F.col("chunk_index") + 0.5, F.lit(1.0)))
    rows = cut.withColumns({"chunk_id": chunks.chunk_id(F.col("doc_id"), F.col("chunk_index")), "chunk_text": F.col("c.text"), "char_start": F.col("c.start"), "char_end": F.col("c.end"), "embedding": vector})
    made = imports.chunk_rows(rows, imports.page_rows(docs, F.lit(None).cast("timestamp")), "model-1")
    return made.select("chunk_id", "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "category", "resolved_category", text.sha256(F.col("chunk_text")).alias("text_sha256"), text.sha256(F.col("metadata")).alias("metadata_sha256"), "embedding_model", F.get("embedding", F.lit(0)).cast("double").alias("first_number"))


# A later run: French documents changed, German ones gone, Spanish ones new; of the pages held
# some were gone before.
SYNC = """WITH o AS (SELECT 'd' || doc_id AS k, trim("text") AS x, doc_id % 3 + 1 AS v, doc_id % 10 = 0 AS d FROM documents WHERE lang <> 'es'),
 n AS (SELECT 'd' || doc_id AS k, trim(CASE WHEN lang = 'fr' THEN upper(substring("text", 1, 3000)) ELSE "text" END) AS x FROM documents WHERE lang <> 'de'),
 j AS (SELECT coalesce(o.k, n.k) AS k, o.x AS ox, n.x AS nx, o.v, coalesce(o.d, false) AS d, CASE WHEN n.k IS NULL THEN 'gone' WHEN o.k IS NULL THEN 'added' WHEN sha256(o.x) = sha256(n.x) THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.k = n.k),
 oc AS (SELECT *, k || '_chunk_' || lpad(i::VARCHAR, 3, '0') AS chunk_id FROM (SELECT *, unnest(range(CASE WHEN length(ox) <= 1400 THEN 1 ELSE ceil((length(ox) - 1400) / 1200.0)::BIGINT + 1 END)) AS i FROM j WHERE ox IS NOT NULL)),
 nc AS (SELECT *, k || '_chunk_' || lpad(i::VARCHAR, 3, '0') AS chunk_id FROM (SELECT *, unnest(range(CASE WHEN length(nx) <= 1400 THEN 1 ELSE ceil((length(nx) - 1400) / 1200.0)::BIGINT + 1 END)) AS i FROM j WHERE state IN ('added', 'changed')))
"""


def _synced(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.lit("").alias("url_hash"), F.lit("t").alias("title"), F.lit("c").alias("category"), F.lit("").alias("resolved_category"), F.lit("content").alias("page_state"), F.lit(False).alias("is_unresolved"), "lang", "text", F.col("doc_id").alias("number"))
    before, now = (F.lit(t).cast("timestamp") for t in ("2024-01-01", "2024-02-01"))

    def cut(docs):
        rows = docs.select("doc_id", "title", "category", "is_unresolved", F.posexplode(chunks.hard_split(F.trim("embedding_text"))).alias("chunk_index", "c"))
        return rows.withColumns({"chunk_id": chunks.chunk_id(F.col("doc_id"), F.col("chunk_index")), "chunk_text": F.col("c.text"), "char_start": F.col("c.start"), "char_end": F.col("c.end")})

    old = d.filter("lang <> 'es'").withColumn("embedding_text", F.col("text"))
    new = d.filter("lang <> 'de'").withColumn("embedding_text", F.when(F.col("lang") == "fr", text.upper(F.substring("text", 1, 3000))).otherwise(F.col("text")))
    held = imports.page_rows(old, before).join(old.select("doc_id", "number"), "doc_id")
    pages = held.withColumn("version", (F.col("number") % 3 + 1).cast("int")).withColumn("deleted_at", F.when(F.col("number") % 10 == 0, before))
    rows = imports.chunk_rows(cut(old), pages).join(pages.select(F.col("id").alias("page_id"), F.col("deleted_at").isNull().alias("live")), "page_id").withColumn("is_active", F.col("live"))
    names = schemas.TABLES["rule_pages"].names, schemas.TABLES["rule_chunks"].names
    return imports.sync_rules(new, cut(new), pages.select(*names[0]), rows.select(*names[1]), now)


@query("p12_sync_pages", SYNC + "SELECT k AS doc_id, CASE state WHEN 'added' THEN 1 WHEN 'changed' THEN v + 1 ELSE v END::INTEGER AS version, sha256(CASE state WHEN 'gone' THEN ox ELSE nx END) AS content_hash, state = 'gone' AS deleted, CASE WHEN state = 'gone' THEN d ELSE false END AS gone_before FROM j")
def p12_sync_pages(spark, sf_dir):
    """Pages after a later run: unchanged, changed, new, gone and come back."""
    pages, _ = _synced(spark, sf_dir)
    gone = F.col("deleted_at").isNotNull()
    return pages.select("doc_id", "version", "content_hash", gone.alias("deleted"), (gone & F.coalesce(F.col("deleted_at") < F.lit("2024-02-01").cast("timestamp"), F.lit(False))).alias("gone_before"))


@query("p12_sync_chunks", SYNC + "SELECT chunk_id, CASE state WHEN 'added' THEN 1 ELSE v + 1 END::INTEGER AS version, true AS is_active, sha256(trim(substring(nx, (i * 1200 + 1)::BIGINT, 1400))) AS text_sha256 FROM nc UNION ALL SELECT chunk_id, v::INTEGER, state = 'same', sha256(trim(substring(ox, (i * 1200 + 1)::BIGINT, 1400))) FROM oc WHERE chunk_id NOT IN (SELECT chunk_id FROM nc)")
def p12_sync_chunks(spark, sf_dir):
    """Their chunks: of changed pages replaced or no longer active."""
    _, rows = _synced(spark, sf_dir)
    return rows.select("chunk_id", "version", "is_active", text.sha256(F.col("chunk_text")).alias("text_sha256"))


@query(
    "b13_legacy_titles",
    "WITH d AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'same' ELSE 't' || conv_id END AS title FROM (SELECT DISTINCT conv_id FROM conversations)), n AS (SELECT title, count(*) AS m FROM d GROUP BY 1), p AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1) SELECT d.title || CASE WHEN k > 1 THEN ' (part ' || (turn + 1) || '/' || k || ')' ELSE '' END || CASE WHEN m > 1 THEN ' [' || d.conv_id || ']' ELSE '' END AS title, c.conv_id || '.' || turn AS chunk_id FROM conversations c JOIN d USING (conv_id) JOIN n USING (title) JOIN p USING (conv_id)",
)
def b13_legacy_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat_ws(".", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("chunk_text"))
    title = F.when(F.col("conv_id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("conv_id")))
    docs = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("doc_id"), title.alias("title"), F.lit("").alias("category"), F.lit("u").alias("url"))
    return imports.legacy_rows(docs, rows).select("title", "chunk_id")


@query(
    "p12_versions",
    """WITH o AS (SELECT doc_id, sha256("text") AS h, (doc_id % 3 + 1)::INTEGER AS v, doc_id % 10 = 0 AS d FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN upper("text") ELSE "text" END) AS h FROM documents WHERE lang <> 'de')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.h ELSE n.h END AS h, CASE WHEN o.doc_id IS NULL THEN 1 WHEN n.doc_id IS NOT NULL AND o.h IS DISTINCT FROM n.h THEN v + 1 ELSE v END AS version, n.doc_id IS NULL AS deleted FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def p12_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang <> 'es'").select("doc_id", text.sha256(F.col("text")).alias("h"), (F.col("doc_id") % 3 + 1).cast("int").alias("version"), (F.col("doc_id") % 10 == 0).alias("deleted"))
    new = d.filter("lang <> 'de'").select("doc_id", text.sha256(F.when(F.col("lang") == "fr", text.upper(F.col("text"))).otherwise(F.col("text"))).alias("h"))
    return mutations.sync_versions(old, new, "doc_id", "h")


CLEAN = r"regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


SITE = r"regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"


@query(
    "x9_resolved_links",
    rf"""SELECT DISTINCT page_id, {SITE} || replace(replace(url_encode(regexp_extract(href, '^[^?#]*', 0)), '%2F', '/'), '%25', '%') AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all({CLEAN}, '<a[^>]+href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/') AND NOT starts_with(href, '//')""",
)
def x9_resolved_links(spark, sf_dir):
    """The addresses each page links to on its own site."""
    return crawl.resolved_links(table(spark, sf_dir, "pages"), "page_id", "html", "url", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0))


@query("c15_skipped_urls", "SELECT page_id, (NOT starts_with(lower(url), 'https://') OR contains(lower(url), 'index.html') OR contains(lower(url), '#')) AS skipped FROM pages")
def c15_skipped_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.skipped(F.col("url"), "https://").alias("skipped"))


@query("c13_noise_pages", r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) IN ('', '/') OR page_id % 50 = 0 AS noise FROM pages")
def c13_noise_pages(spark, sf_dir):
    name = F.when(F.col("page_id") % 50 == 0, " Suche ").otherwise("a page")
    crumbs = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Example Wiki"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    return table(spark, sf_dir, "pages").select("page_id", pages.is_noise(F.col("url"), name, crumbs, F.lit(1), "Example Wiki", "Suche", "Welcome to").alias("noise"))


@query("x8_page_records")
def x8_page_records(spark, sf_dir):
    """The record of each page, read with a parser of nested elements."""
    r = table(spark, sf_dir, "pages").select("page_id", pages.record(F.col("html")).alias("r"))
    return r.select("page_id", "r.name", F.size("r.breadcrumbs").alias("n_breadcrumbs"), F.size("r.properties").alias("n_properties"), F.size("r.extensions").alias("n_extensions"), F.sha2("r.description", 256).alias("description_sha256"), "r.error")




@query(
    "x10_page_state",
    f"""WITH f AS (SELECT page_id, len(regexp_extract_all({CLEAN}, '<a[^>]+href="([^"]+)"', 1))::INTEGER AS n_links, contains(lower({CLEAN}), 'released under') AS has_labels,
 len(list_filter(string_split({CLEAN}, '<p>')[2:], lambda p: length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(split_part(p, '</p>', 1), '(?s)^(.*?)(?:</article>|$)', 1), '<[^>]*>', ' ', 'g'), '&[a-z]+;', '&', 'g'), '\\s+', ' ', 'g'))) >= 80)) > 0 AS has_text FROM pages)
SELECT page_id, n_links, has_text, CASE WHEN (has_text OR has_labels) AND (n_links >= 5 OR (has_text AND n_links >= 3)) THEN 'hybrid' WHEN has_text OR has_labels THEN 'content' ELSE 'crawl_only' END AS page_state FROM f""",
)
def x10_page_state(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select("page_id", pages.features(F.col("html"), "https://site/", ["released under"]).alias("f"))
    return f.select("page_id", "f.n_links", "f.has_text", pages.page_class(F.col("f")).page_state.alias("page_state"))


# A site that answers for the pages of all hosts: under their own addresses (the first page of
# each), and for most of the addresses that they link to with some page.  Three categories, one after the other.
LANGUAGES = ("fr", "de", "en")
_SITE = f"""SELECT page_id, 'https://site' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1), '#.*$', '') AS own, {CLEAN} AS c FROM pages"""
CRAWL = rf"""WITH RECURSIVE g AS ({_SITE}),
 f AS (SELECT page_id, own, c, len(regexp_extract_all(c, '<a[^>]+href="([^"]+)"', 1)) AS n_links, contains(lower(c), 'released under') AS has_labels,
  len(list_filter(string_split(c, '<p>')[2:], lambda p: length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(split_part(p, '</p>', 1), '(?s)^(.*?)(?:</article>|$)', 1), '<[^>]*>', ' ', 'g'), '&[a-z]+;', '&', 'g'), '\s+', ' ', 'g'))) >= 80)) > 0 AS has_text FROM g),
 s AS (SELECT page_id, own, n_links >= 5 OR (has_text AND n_links >= 3) AS follow, CASE WHEN (has_text OR has_labels) AND (n_links >= 5 OR (has_text AND n_links >= 3)) THEN 'hybrid' WHEN has_text OR has_labels THEN 'content' ELSE 'crawl_only' END AS page_state FROM f),
 h AS (SELECT DISTINCT page_id, 'https://site' || replace(replace(url_encode(href), '%2F', '/'), '%25', '%') AS target FROM (SELECT page_id, unnest(regexp_extract_all(c, '<a[^>]+href="([^"]*)"', 1)) AS href FROM g) WHERE starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT contains(href, '#')),
 v AS (SELECT own AS url, min(page_id) AS page_id FROM s GROUP BY own UNION SELECT target, k FROM (SELECT DISTINCT target, ('0x' || left(md5(target), 8))::BIGINT AS m, (SELECT count(*) FROM pages) AS n FROM h), LATERAL (SELECT m % n AS k) WHERE m % 7 <> 0 AND target NOT IN (SELECT own FROM s)),
 l AS (SELECT url, target FROM v JOIN s USING (page_id) JOIN h USING (page_id) WHERE follow),
 {", ".join(f"""a{i}(url, hop) AS (SELECT own, 0 FROM s WHERE contains(own, '/{c}/') {"".join(f"AND own NOT IN (SELECT url FROM d{j})" for j in range(i))}
  UNION SELECT l.target, hop + 1 FROM a{i} JOIN l USING (url) WHERE hop < 40 {"".join(f"AND target NOT IN (SELECT url FROM d{j})" for j in range(i))}),
 b{i} AS (SELECT url, min(hop) AS hop FROM a{i} GROUP BY url), d{i} AS (SELECT url, hop, '{c}' AS category FROM b{i} WHERE url IN (SELECT url FROM v)),
 t{i} AS (SELECT url, '{c}' AS source FROM d{i} UNION SELECT own, '{c}' FROM s WHERE contains(own, '/{c}/') UNION SELECT target, '{c}' FROM l JOIN d{i} USING (url))""" for i, c in enumerate(LANGUAGES))},
 d AS ({" UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(len(LANGUAGES)))}), t AS ({" UNION ".join(f"SELECT * FROM t{i}" for i in range(len(LANGUAGES)))}),
 x AS ({" UNION ".join(f"SELECT url, '{c}' AS category FROM b{i} WHERE url NOT IN (SELECT url FROM v)" for i, c in enumerate(LANGUAGES))})
"""


def _crawled(spark, sf_dir):
    own = F.concat(F.lit("https://site"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1), "#.*$", ""))
    p = table(spark, sf_dir, "pages").select("page_id", own.alias("url"), "html")
    targets = crawl.resolved_links(p, "page_id", "html", "url", F.lit("https://site/")).select("target").distinct().filter(~F.col("target").contains("#")).join(p.select(F.col("url").alias("target")), "target", "left_anti")
    n = p.count()
    number = F.conv(F.left(F.md5("target"), F.lit(8)), 16, 10).cast("long")
    served = targets.filter(number % 7 != 0).select(F.col("target").alias("url"), (number % max(n, 1)).alias("page_id")).join(p.select("page_id", "html"), "page_id").select("url", "html")
    site = p.groupBy("url").agg(F.min_by("html", "page_id").alias("html")).union(served).withColumn("error", F.lit(None).cast("string"))
    seeds = [(c, p.filter(F.col("url").contains(f"/{c}/")).select("url")) for c in LANGUAGES]
    return crawl.crawl(site, seeds, f"{shared_folder(spark)}/crawl", "https://site/", ["released under"])


@query("x11_crawl", CRAWL + "SELECT d.url, d.category, page_state, hop, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM d JOIN v USING (url) JOIN s USING (page_id) JOIN t ON t.url = d.url GROUP BY ALL")
def x11_crawl(spark, sf_dir):
    """The pages completed, with the round and the category that first reached them."""
    return _crawled(spark, sf_dir).completed.select("url", "category", "page_state", "hop", F.array_join("sources", ",").alias("sources"))


@query("x11_crawl_pending", CRAWL + "SELECT url, category, 'not found' AS error FROM x")
def x11_crawl_pending(spark, sf_dir):
    """Addresses that no page answers, for each category that met them."""
    found = _crawled(spark, sf_dir)
    return found.pending.join(found.failed, "url").select("url", "category", "error")


@query("i12_url_of_file", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://h/a.html?key=' || page_id || '_x' ELSE 'https://h/a/b' || page_id || '.html' END AS url FROM pages")
def i12_url_of_file(spark, sf_dir):
    key = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a.html_key_"), key, F.lit("_x.html"))).otherwise(F.concat(F.lit("a_b"), key, F.lit(".html")))
    return table(spark, sf_dir, "pages").select("page_id", html.url_of_file(name, "https://h/").alias("url"))


@query("i12_page_files", r"""SELECT page_id, left(regexp_replace(trim(replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', '_'), '_') || CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) <> '' THEN '_' || translate(regexp_extract(url, '[?]([^#]*)', 1), '/=', '__') ELSE '' END, '[<>:"/\\|?*]', '_', 'g'), 200) || '.html' AS file FROM pages""")
def i12_page_files(spark, sf_dir):
    """The file that each page is kept in."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_file(F.col("url")).alias("file"))


FILES = "p_name || '-' || CASE p_size % 8 WHEN 0 THEN 'Conditions' WHEN 1 THEN 'status' WHEN 2 THEN 'wounds' WHEN 3 THEN 'maneuver-talent' WHEN 4 THEN 'Spells' WHEN 5 THEN 'talent' WHEN 6 THEN 'combat-status' ELSE 'x' END || '.md'"


@query("i28_file_categories", f"SELECT p_partkey, CASE WHEN contains(f, 'conditions') THEN 'condition' WHEN contains(f, 'status') THEN 'status' WHEN contains(f, 'wound') THEN 'combat' WHEN contains(f, 'maneuver') THEN 'maneuver' WHEN contains(f, 'spell') THEN 'spell' WHEN contains(f, 'talent') THEN 'talent' WHEN contains(f, 'combat') THEN 'combat' ELSE 'general' END AS category FROM (SELECT p_partkey, lower({FILES}) AS f FROM part)")
def i28_file_categories(spark, sf_dir):
    """The first word of the list that a name holds decides, not the first in the name."""
    return table(spark, sf_dir, "part").select("p_partkey", text.file_category(F.expr(FILES)).alias("category"))


@query("i28_markdown_heads", """SELECT doc_id, 'https://s/' || doc_id AS source_url, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'file' END AS heading FROM documents WHERE "text" IS NOT NULL""")
def i28_markdown_heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## "), F.col("source"))).otherwise("no heading")
    body = F.concat(head, F.lit("\n*Source: https://s/"), F.col("doc_id"), F.lit(" *\n"), F.replace("text", F.lit("#"), F.lit("")))
    return d.select("doc_id", text.source_url(body).alias("source_url"), text.first_heading(body, F.lit("file")).alias("heading"))


@query("a11_embedding_input", """SELECT doc_id, sha256(left(replace("text", chr(10), ' '), 8000)) AS input_sha256 FROM documents""")
def a11_embedding_input(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(text.embedding_input(F.col("text"))).alias("input_sha256"))


@query("i7_flattened", """SELECT doc_id, CASE WHEN coalesce(trim(lang), '') <> '' THEN 'lang: ' || lang ELSE '' END || CASE WHEN coalesce(trim(lang), '') <> '' AND doc_id % 2 = 0 THEN chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'source: ' || source ELSE '' END AS lines FROM documents""")
def i7_flattened(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array(pair("lang", F.col("lang")), pair("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", text.flattened(pairs).alias("lines"))


@query("i8_first_of", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), 'none') AS label FROM documents")
def i8_first_of(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_of(lang, F.col("source"), F.lit("none")).alias("label"))


@query("i10_decoded_urls", rf"""SELECT page_id, lower('/' || regexp_replace(t, '[%?#]', '', 'g') || '?q=' || page_id) AS decoded FROM (SELECT page_id, {HEADING} AS t FROM pages)""")
def i10_decoded_urls(spark, sf_dir):
    """Addresses made of the pages' titles, encoded and decoded again."""
    title = F.regexp_replace(html.heading(F.col("html")), "[%?#]", "")
    url = addresses.encoded(F.concat(F.lit("https://h/"), title, F.lit("?q="), F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", html.decoded(url).alias("decoded"))
