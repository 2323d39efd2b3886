"""Documents, pages, links, categories and the audit."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import addresses, html, text
from brindle.operators import audit, categorize, chunks, crawl, mutations, ranking
from brindle.plans.base import query, shared_folder, table


FOLD = r"""WITH RECURSIVE d AS (SELECT doc_id, string_split("text", chr(10)) AS ps FROM documents WHERE "text" IS NOT NULL),
 r AS (SELECT doc_id, ps, 0::BIGINT AS i, 0::BIGINT AS pos, NULL::VARCHAR AS o, 0::BIGINT AS o_start, 0::BIGINT AS o_end, []::STRUCT(t VARCHAR, a BIGINT, b BIGINT)[] AS made FROM d
 UNION ALL SELECT doc_id, ps, i + 1, pos + length(p) + 1,
  CASE WHEN t = '' THEN o WHEN length(t) > 1400 THEN NULL WHEN fits THEN o || chr(10) || t ELSE t END,
  CASE WHEN t = '' OR fits THEN o_start ELSE start END, CASE WHEN t = '' THEN o_end ELSE start + length(t) END,
  CASE WHEN t = '' OR fits THEN [] ELSE list_concat(CASE WHEN o IS NULL THEN [] ELSE [{'t': o, 'a': o_start, 'b': o_end}] END,
   CASE WHEN length(t) <= 1400 THEN [] ELSE list_transform(range(ceil((length(t) - 1400) / 1200.0)::BIGINT + 1), lambda k: {'t': substring(t, k * 1200 + 1, 1400), 'a': start + k * 1200, 'b': start + least(k * 1200 + 1400, length(t))}) END) END
  FROM (SELECT *, (o IS NOT NULL AND t <> '' AND length(t) <= 1400 AND length(o) + 1 + length(t) <= 1400) AS fits FROM (SELECT *, trim(p, W) AS t, pos + length(p) - length(ltrim(p, W)) AS start FROM (SELECT *, ps[i + 1] AS p FROM r WHERE i < len(ps))))),
 made AS (SELECT doc_id, i, unnest(made) AS c, generate_subscripts(made, 1) AS j FROM r UNION ALL SELECT doc_id, i + 1, {'t': o, 'a': o_start, 'b': o_end}, 1 FROM r WHERE i = len(ps) AND o IS NOT NULL),
 c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k, c.t AS t, c.a AS a, c.b AS b FROM made)""".replace("W)", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@query("t1_paragraph_pack", f"""{FOLD} SELECT d.doc_id, count(c.t) AS n_chunks, sha256(coalesce(string_agg(c.t, chr(1) ORDER BY k), '')) AS chunks_sha256 FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def t1_paragraph_pack(spark, sf_dir):
    """Lines packed into chunks: number of chunks and hash of their texts."""
    packed = table(spark, sf_dir, "documents").select("doc_id", chunks.pack(F.col("text"), "\n").alias("c"))
    return packed.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join(F.transform("c", lambda c: c.text), "\x01"), 256).alias("chunks_sha256"))


@query("t3_build_chunks", f"""{FOLD}, w AS (SELECT doc_id, k, t, a, b FROM c UNION ALL SELECT doc_id, 0, coalesce("text", ''), 0, length(coalesce("text", '')) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, k AS chunk_index, doc_id || '_chunk_' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') AS chunk_id, sha256(t) AS chunk_sha256, a AS char_start, b AS char_end FROM w""")
def t3_build_chunks(spark, sf_dir):
    built = chunks.build_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", separator="\n")
    return built.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.sha2("chunk_text", 256).alias("chunk_sha256"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(
    "t2_hard_split",
    """SELECT doc_id, 'd' || doc_id || '_chunk_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS chunk_id, (i * 1200)::BIGINT AS char_start,
  least(i * 1200 + 1400, length("text"))::BIGINT AS char_end, sha256(substring("text", (i * 1200 + 1)::BIGINT, 1400)) AS chunk_sha256
FROM (SELECT *, unnest(range(CASE WHEN length("text") <= 1400 THEN 1 ELSE ceil((length("text") - 1400) / 1200)::BIGINT + 1 END)) AS i FROM documents WHERE "text" IS NOT NULL)""",
)
def t2_hard_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(chunks.hard_split(F.col("text"))).alias("i", "c"))
    return rows.select("doc_id", chunks.chunk_id(F.concat(F.lit("d"), F.col("doc_id")), F.col("i")).alias("chunk_id"), F.col("c.start").cast("long").alias("char_start"), F.col("c.end").cast("long").alias("char_end"), F.sha2("c.text", 256).alias("chunk_sha256"))


SECTIONED = r"""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(replace("text", '. ', chr(10) || '## '), chr(10) || '## '), lambda p: CASE WHEN starts_with(p, '#') THEN p ELSE '## ' || p END) AS ps FROM documents WHERE "text" IS NOT NULL),
 r AS (SELECT doc_id, ps, 0::BIGINT AS i, ''::VARCHAR AS o, 0.0::DOUBLE AS n, NULL::VARCHAR AS made FROM d
 UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_up THEN p ELSE o || chr(10) || p END, CASE WHEN full_up THEN q ELSE n + q END, CASE WHEN full_up THEN o END
  FROM (SELECT *, (n + q > 60 AND o <> '') AS full_up FROM (SELECT *, ps[i + 1] AS p, (len(string_split_regex(ps[i + 1], '[\x20\t\n\r\f\x0B]+')) * 1.3)::DOUBLE AS q FROM r WHERE i < len(ps)))),
 c AS (SELECT doc_id, i, trim(made, W) AS t FROM r WHERE made IS NOT NULL UNION ALL SELECT doc_id, i + 1, trim(o, W) FROM r WHERE i = len(ps))""".replace("W)", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@query("t5_legacy_chunks", f"""{SECTIONED} SELECT d.doc_id, count(t)::BIGINT AS n_chunks, sha256(coalesce(string_agg(t, chr(1) ORDER BY i), '')) AS chunks_sha256 FROM documents d LEFT JOIN (SELECT * FROM c WHERE length(t) > 100) c USING (doc_id) WHERE d."text" IS NOT NULL GROUP BY d.doc_id""")
def t5_legacy_chunks(spark, sf_dir):
    """Sentences as sections, packed to 60 tokens."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    found = d.select("doc_id", chunks.legacy_chunks(F.replace("text", F.lit(". "), F.lit("\n## ")), 60).alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join("c", "\x01"), 256).alias("chunks_sha256"))


@query(
    "e16_export_summary",
    """SELECT count(*) AS documents, count(l.doc_id) AS resolved, count(*) - count(l.doc_id) AS unresolved,
  coalesce(sum(CASE WHEN length("text") <= 1400 THEN 1 ELSE ceil((length("text") - 1400) / 1200)::BIGINT + 1 END), 0)::BIGINT AS chunks,
  count(*) FILTER (WHERE length("text") < 80) AS thin FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def e16_export_summary(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    n = F.char_length("text")
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    pieces = F.when(n <= 1400, 1).otherwise(F.ceil((n - 1400) / 1200) + 1)
    return d.agg(F.count("*").alias("documents"), F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"), F.coalesce(F.sum(pieces), F.lit(0)).cast("long").alias("chunks"), F.count_if(n < 80).alias("thin"))


@query(
    "i6_embedding_text",
    """SELECT doc_id, sha256(array_to_string(list_filter(['Title: ' || source, 'Category: ' || lang, CASE WHEN "text" <> '' THEN "text" END], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS text_sha256 FROM documents""",
)
def i6_embedding_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(text.sections(("Title", F.col("source")), ("Category", F.col("lang")), ("", F.col("text")))).alias("text_sha256"))


@query("i2_doc_ids", "SELECT page_id, sha256(url) AS url_hash, 'doc_' || left(sha256(url), 16) AS doc_id FROM pages")
def i2_doc_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sha256(F.col("url")).alias("url_hash"), text.doc_id(F.col("url")).alias("doc_id"))


@query("i4_slug", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM pages")
def i4_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(
    "i14_truncate_words",
    """SELECT doc_id, sha256(CASE WHEN length("text") <= 1500 THEN "text" ELSE
  (CASE WHEN strpos(left("text", 1500), ' ') > 0 AND 1500 - strpos(reverse(left("text", 1500)), ' ') > 900 THEN left(left("text", 1500), (1500 - strpos(reverse(left("text", 1500)), ' '))::BIGINT) ELSE left("text", 1500) END) || '…' END) AS cut_sha256 FROM documents""",
)
def i14_truncate_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(text.cut_at_word(F.col("text"), 1500)).alias("cut_sha256"))


@query("i15_truncate_fixed", "SELECT page_id, CASE WHEN length(url) > 24 THEN left(url, 21) || '...' ELSE url END AS short FROM pages")
def i15_truncate_fixed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.cut_at(F.col("url"), 24, 21).alias("short"))


@query(
    "i16_log_normalize",
    """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Turn: ' || role WHEN 1 THEN 'Combat started' WHEN 2 THEN 'Combat ended: ' || role || ' won' ELSE role || ' hits | ' || turn END AS line FROM conversations""",
)
def i16_log_normalize(spark, sf_dir):
    """Log lines of all shapes, made of role and turn."""
    k, role = F.col("conv_id") % 5, F.col("role")
    made = F.when(k == 0, F.concat(F.lit("--- "), role, F.lit("'s Turn ---"))).when(k == 1, "--- Combat Started! ---").when(k == 2, F.concat(F.lit(" --- Combat Ended: "), role, F.lit(" won ---"))).otherwise(F.concat(F.lit("**"), role, F.lit("** hits.  |  "), F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.log_line(made).alias("line"))


@query("i9_status_code", r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '\b(\d{3})\b', 1), '') AS INTEGER) AS status FROM pages")
def i9_status_code(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.status_code(F.col("url")).alias("status"))


@query("i12_file_names", r"SELECT page_id, left(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 200) AS file_name FROM pages")
def i12_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("file_name"))


@query("i13_item_id", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&][^=&#]*=([^&#]*)', 1), ''), left(sha256(url), 8)) AS item_id FROM pages")
def i13_item_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.item_id(F.col("url"), F.lit("")).alias("item_id"))


CLEAN = r"regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"
BARE = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '[\x20\t\n\r\f\x0B]+', ' ', 'g'))"


HEADING = f"coalesce(nullif({BARE(f'''regexp_extract({CLEAN}, '(?s)<h1[^>]*>(.*?)</h1>', 1)''')}, ''), {BARE('''regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)''')})"


@query("x2_page_title", f"SELECT page_id, {HEADING} AS title FROM pages")
def x2_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.heading(F.col("html")).alias("title"))


@query("i5_normalized_titles", rf"""SELECT page_id, trim(regexp_replace(lower(regexp_replace(strip_accents(t), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS title FROM (SELECT page_id, {HEADING} AS t FROM pages)""")
def i5_normalized_titles(spark, sf_dir):
    """Titles folded to ASCII; the SQL knows the accents that are in the data."""
    return table(spark, sf_dir, "pages").select("page_id", text.ascii_folded(html.heading(F.col("html"))).alias("title"))


LONG = f"list_filter(list_transform(regexp_extract_all({CLEAN}, '(?s)<p>(.*?)</p>', 1), lambda p: {BARE('p')}), lambda p: length(p) >= 40)"


@query("x5_long_paragraphs", f"SELECT page_id, len({LONG})::BIGINT AS n_paragraphs, sha256(array_to_string({LONG}, chr(10) || chr(10))) AS description_sha256 FROM pages")
def x5_long_paragraphs(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", html.paragraphs(F.col("html")).alias("p"))
    return found.select("page_id", F.size("p").cast("long").alias("n_paragraphs"), text.sha256(F.array_join("p", "\n\n")).alias("description_sha256"))


HREFS = f"""regexp_extract_all({CLEAN}, '<a[^>]+href="([^"]*)"', 1)"""


@query("x9_link_edges", f"SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest({HREFS}) AS href FROM pages) WHERE starts_with(href, '/') AND NOT starts_with(href, '//')")
def x9_link_edges(spark, sf_dir):
    return crawl.links(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "href")


@query(
    "i11_absolute_links",
    rf"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || replace(replace(url_encode(regexp_extract(href, '^[^?#]*', 0)), '%2F', '/'), '%25', '%')
 || CASE WHEN regexp_extract(href, '^[^?#]*[?]([^#]*)', 1) <> '' THEN '?' || url_encode(regexp_extract(href, '^[^?#]*[?]([^#]*)', 1)) ELSE '' END || CASE WHEN regexp_extract(href, '#(.*)$', 1) <> '' THEN '#' || url_encode(regexp_extract(href, '#(.*)$', 1)) ELSE '' END AS target
FROM (SELECT DISTINCT page_id, url, href FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages) WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))""",
)
def i11_absolute_links(spark, sf_dir):
    found = crawl.links(table(spark, sf_dir, "pages"), "page_id", "html", keep=["url"])
    return found.select("page_id", addresses.encoded(addresses.absolute(F.col("url"), F.col("href"))).alias("target"))


# Example rules for the driver's pages: category and words, in order.
URL_RULES = [("french", ["/fr/"]), ("german", ["/de/"]), ("spanish", ["/es/"]), ("mobile", ["://m."]), ("tracked", ["ref=", "utm_"])]


@query("x13_url_category", "SELECT page_id, CASE WHEN contains(lower(url), '/fr/') THEN 'french' WHEN contains(lower(url), '/de/') THEN 'german' WHEN contains(lower(url), '/es/') THEN 'spanish' WHEN contains(lower(url), '://m.') THEN 'mobile' WHEN contains(lower(url), 'ref=') OR contains(lower(url), 'utm_') THEN 'tracked' ELSE 'other' END AS category FROM pages")
def x13_url_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", categorize.keyword_category(F.col("url"), URL_RULES, "other").alias("category"))


PATTERNS = [("french", "/fr/"), ("german", "/de/"), ("spanish", "/es/"), ("english", "/en/"), ("commercial", r"\.com/"), ("network", r"\.net/"), ("organisation", r"\.org/"), ("tracked", "[?&]ref=")]
VOTES = "SELECT page_id, category, CASE WHEN n = 1 THEN 90 ELSE 45 END AS points, 'url' AS reason FROM (SELECT page_id, category, count(*) OVER (PARTITION BY page_id) AS n FROM pages JOIN (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in PATTERNS) + ") t(category, pattern) ON regexp_matches(url, pattern))"


def _votes(spark, sf_dir):
    return categorize.pattern_votes(table(spark, sf_dir, "pages"), "page_id", F.col("url"), PATTERNS, categorize.URL_ONE, categorize.URL_MANY, "url")


@query("d9_pattern_votes", VOTES)
def d9_pattern_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


CRUMBS = "SELECT page_id, 'french' AS category, 80 AS points FROM pages WHERE contains(html, 'lang=\"fr\"') UNION ALL SELECT page_id, 'german', 80 FROM pages WHERE contains(html, 'lang=\"de\"') UNION ALL SELECT page_id, 'spanish', 80 FROM pages WHERE contains(html, 'lang=\"es\"')"


@query(
    "f3_resolve_category",
    f"""WITH s AS (SELECT page_id, category, sum(points)::BIGINT AS score FROM (SELECT page_id, category, points FROM ({VOTES}) UNION ALL ({CRUMBS})) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, category)),
 c AS (SELECT *, CASE WHEN score < 60 THEN 'low' WHEN second >= score - 10 THEN 'ambiguous' WHEN score >= 100 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE rk = 1)
SELECT p.page_id, CASE WHEN confidence IN ('high', 'medium') THEN category ELSE 'unresolved' END AS category, coalesce(score, 0)::BIGINT AS score, coalesce(confidence, 'none') AS confidence FROM pages p LEFT JOIN c USING (page_id)""",
)
def f3_resolve_category(spark, sf_dir):
    lang = categorize.pattern_votes(table(spark, sf_dir, "pages"), "page_id", F.col("html"), [("french", 'lang="fr"'), ("german", 'lang="de"'), ("spanish", 'lang="es"')], categorize.CRUMB_ONE, categorize.CRUMB_ONE, "lang")
    keys = table(spark, sf_dir, "pages").select("page_id")
    return categorize.resolve(_votes(spark, sf_dir).unionByName(lang), "page_id", keys).select("page_id", "category", "score", "confidence")


@query(
    "x11_reachability",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS s, n_nationkey AS d FROM nation WHERE n_nationkey > 4 UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation),
 r(node, source, hop) AS (SELECT k, 'from ' || k, 0 FROM (VALUES (0), (7)) t(k) UNION SELECT e.d, r.source, r.hop + 1 FROM r JOIN e ON e.s = r.node WHERE r.hop < 25)
SELECT node, min(hop) AS hop, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM r GROUP BY node""",
)
def x11_reachability(spark, sf_dir):
    """All that can be reached from two starts, until nothing new is found."""
    n = table(spark, sf_dir, "nation")
    edges = n.filter("n_nationkey > 4").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")).union(n.select("n_nationkey", (F.col("n_nationkey") * 3 + 1) % 25)).distinct()
    start = spark.createDataFrame([(0, "from 0"), (7, "from 7")], "node int, source string")
    found = crawl.reachable(edges, start, shared_folder(spark))
    return found.select("node", "hop", F.array_join("sources", ",").alias("sources"))


@query(
    "x14_missing_links",
    f"SELECT href, count(*) AS n_pages FROM (SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest({HREFS}) AS href FROM pages) WHERE starts_with(href, '/') AND NOT starts_with(href, '//')) WHERE href NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) FROM pages) GROUP BY href",
)
def x14_missing_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    known = p.select(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("href")).distinct()
    return crawl.links(p, "page_id", "html").join(known, "href", "left_anti").groupBy("href").agg(F.count("*").alias("n_pages"))


INVENTORY = """SELECT doc_id, bool_or(s = 'documents') AS in_documents, bool_or(s = 'labels') AS in_labels, bool_or(s = 'items') AS in_items,
  count(*) FILTER (WHERE s = 'documents') AS n_documents, count(*) FILTER (WHERE s = 'labels') AS n_labels, count(*) FILTER (WHERE s = 'items') AS n_items
FROM (SELECT doc_id, 'documents' AS s FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT item_id + 1000000, 'items' FROM benchmark) GROUP BY doc_id"""


def _inventory(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000).alias("doc_id"))
    return audit.inventory("doc_id", documents=table(spark, sf_dir, "documents").filter("lang <> 'de'"), labels=table(spark, sf_dir, "labels"), items=items)


@query("x17_inventory", INVENTORY)
def x17_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query("e2_coverage_summary", f"SELECT count(*) AS total, count_if(in_documents) AS documents, count_if(in_labels) AS labels, count_if(in_items) AS items, count_if(in_labels AND NOT in_documents) AS labels_only, count_if(in_documents AND in_labels) AS both_sides FROM ({INVENTORY})")
def e2_coverage_summary(spark, sf_dir):
    d, lab, i = F.col("in_documents"), F.col("in_labels"), F.col("in_items")
    return audit.coverage(_inventory(spark, sf_dir), [], {"documents": d, "labels": lab, "items": i, "labels_only": lab & ~d, "both_sides": d & lab})


@query("e3_coverage_by_group", "SELECT coalesce(lang, 'unresolved') AS category, count(*) AS total, count_if(length(\"text\") < 80) AS thin, count_if(length(\"text\") >= 1400) AS chunked, count_if(source = 'src0') AS hot FROM documents GROUP BY 1")
def e3_coverage_by_group(spark, sf_dir):
    n = F.char_length("text")
    return audit.coverage(table(spark, sf_dir, "documents"), [F.coalesce("lang", F.lit("unresolved")).alias("category")], {"thin": n < 80, "chunked": n >= 1400, "hot": F.col("source") == "src0"})


@query(
    "x18_audit_report",
    f"""SELECT severity, type, count(*) AS n, min(subject) AS first_subject FROM (
  SELECT 'hard' AS severity, 'missing_from_documents' AS type, doc_id::VARCHAR AS subject FROM ({INVENTORY}) WHERE in_labels AND NOT in_documents
  UNION ALL SELECT 'hard', 'orphan_document', doc_id::VARCHAR FROM ({INVENTORY}) WHERE in_documents AND NOT in_labels
  UNION ALL SELECT 'warn', 'item_without_document', doc_id::VARCHAR FROM ({INVENTORY}) WHERE in_items AND NOT in_documents
  UNION ALL SELECT 'hard', 'duplicate_text', min(doc_id)::VARCHAR FROM documents GROUP BY sha256("text") HAVING count(*) > 1) GROUP BY 1, 2""",
)
def x18_audit_report(spark, sf_dir):
    inv = _inventory(spark, sf_dir)
    key = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    rows = audit.report(
        audit.anomaly(inv.filter("in_labels and not in_documents"), key, "missing_from_documents", "hard"),
        audit.anomaly(inv.filter("in_documents and not in_labels"), key, "orphan_document", "hard"),
        audit.anomaly(inv.filter("in_items and not in_documents"), key, "item_without_document", "warn"),
        audit.anomaly(audit.duplicates(d, [text.sha256(F.col("text")).alias("h")], "doc_id"), F.col("first"), "duplicate_text", "hard"),
    )
    return rows.groupBy("severity", "type").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


@query("e7_duplicates", 'SELECT sha256("text") AS text_hash, count(*) AS copies, min(doc_id) AS "first", max(doc_id) AS "last" FROM documents GROUP BY 1 HAVING count(*) > 1')
def e7_duplicates(spark, sf_dir):
    return audit.duplicates(table(spark, sf_dir, "documents"), [text.sha256(F.col("text")).alias("text_hash")], "doc_id")


@query("e18_thin_content", "SELECT doc_id, lang, length(\"text\")::BIGINT AS n FROM documents WHERE length(\"text\") < 80")
def e18_thin_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.char_length("text") < 80).select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))


@query(
    "p12_hash_sync",
    """WITH a AS (SELECT doc_id, sha256("text") AS h FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN upper("text") ELSE "text" END) AS h FROM documents WHERE lang <> 'de')
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'update' END AS action FROM a FULL JOIN b USING (doc_id)""",
)
def p12_hash_sync(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang <> 'es'").select("doc_id", text.sha256(F.col("text")).alias("h"))
    new = d.filter("lang <> 'de'").select("doc_id", text.sha256(F.when(F.col("lang") == "fr", text.upper(F.col("text"))).otherwise(F.col("text"))).alias("h"))
    return mutations.sync(old, new, "doc_id", "h")


@query("f7_batches", "SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch FROM documents) GROUP BY 1, 2")
def f7_batches(spark, sf_dir):
    return ranking.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 50).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "f8_log_tail",
    """SELECT conv_id, count(*) AS n, sha256(string_agg("text", chr(10) ORDER BY turn)) AS log_sha256 FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id""",
)
def f8_log_tail(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, sf_dir, "conversations").withColumn("r", rank).filter("r <= 20")
    logs = last.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("log"))
    return logs.select("conv_id", "n", F.sha2(F.array_join(F.transform("log", lambda t: t.text), "\n"), 256).alias("log_sha256"))
