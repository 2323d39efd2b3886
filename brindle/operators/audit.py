"""Coverage audit.

Tables: page_index (url, category, provisional_category, resolved_category,
page_state, crawl_sources, resolution_confidence, resolution_evidence, filepath),
emitted (url, category, file_order, item struct<name, category, breadcrumbs,
subcategory, description, ...>), completed (url), failed (url, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text


def inventory(key: str, **sources: DataFrame) -> DataFrame:
    """A row for each key of any source, with flags in_<source>; one aggregate over
    the tagged union instead of a chain of outer joins."""
    tagged = None
    for name, df in sources.items():
        part = df.select(F.col(key), F.lit(name).alias("__source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = [F.bool_or(F.col("__source") == name).alias(f"in_{name}") for name in sources]
    counts = [F.count_if(F.col("__source") == name).alias(f"n_{name}") for name in sources]
    return tagged.groupBy(key).agg(*flags, *counts)


def coverage(rows: DataFrame, group: list[Column], metrics: dict[str, Column]) -> DataFrame:
    """Counts of rows for which each condition holds, by group (or over all)."""
    counts = [F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in metrics.items())]
    return rows.groupBy(*group).agg(*counts) if group else rows.agg(*counts)


def anomaly(rows: DataFrame, key: Column, kind: str, severity: str) -> DataFrame:
    """Rows of the report: severity, type, subject."""
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), key.cast("string").alias("subject"))


def report(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicates(rows: DataFrame, by: list[Column], member: str) -> DataFrame:
    """Groups of more than one row: their keys, count and sorted distinct members."""
    grouped = rows.groupBy(*by).agg(F.count("*").alias("copies"), F.min(member).alias("first"), F.max(member).alias("last"))
    return grouped.filter("copies > 1")


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def effective_category(resolved: Column, category: Column) -> Column:
    return F.coalesce(F.nullif(resolved, F.lit("")), F.nullif(category, F.lit("")), F.lit("unresolved"))


def expected_categories(resolved: Column, category: Column, crawl_sources: Column) -> Column:
    """Where a page may be emitted: resolved and own category, else its crawl sources."""
    own = F.array_distinct(F.filter(F.array(F.nullif(resolved, F.lit("")), F.when(category != "unresolved", F.nullif(category, F.lit("")))), lambda c: c.isNotNull()))
    sources = F.filter(F.coalesce(crawl_sources, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return F.when(F.size(own) > 0, own).otherwise(sources)


def in_categories(categories: list[str] | None, *, sources: str = "crawl_sources") -> Column:
    """Whether a page belongs to one of the categories by any of its keys."""
    if not categories:
        return F.lit(True)
    own = [F.coalesce(F.col(c).isin(*categories), F.lit(False)) for c in ("resolved_category", "provisional_category", "category")]
    crawled = F.coalesce(F.arrays_overlap(F.col(sources), F.array(*map(F.lit, categories))), F.lit(False))
    return own[0] | own[1] | own[2] | crawled


def last_of_url(page_index: DataFrame) -> DataFrame:
    """The last row of each url: that of greatest ``position`` where there is such a column,
    else the greatest by all columns."""
    rest = F.struct(*(c for c in page_index.columns if c != "url"))
    order = F.struct("position", rest) if "position" in page_index.columns else rest
    return page_index.groupBy("url").agg(F.max_by(rest, order).alias("__e")).select("url", "__e.*").select(*page_index.columns)


def _parseable() -> Column:
    return F.col("page_state").isin("content", "hybrid") & (F.coalesce("resolved_category", F.lit("")) != "crawl_only")


def expected(page_index: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Pages that should have a record (C9, X19); of a repeated url the last row that
    should."""
    return last_of_url(page_index.filter(_given("url").isNotNull() & _parseable() & in_categories(categories)))


def emitted_rows(emitted: DataFrame, page_index: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Records with an address, of the categories asked for (X19): those of the
    unresolved file only if their page is of such a category."""
    rows = emitted.filter(_given("url").isNotNull())
    if not categories:
        return rows
    known = last_of_url(page_index).filter(in_categories(categories)).select("url")
    own = rows.filter(F.col("category").isin(*categories) & (F.col("category") != "unresolved"))
    return own.unionByName(rows.filter("category = 'unresolved'").join(known, "url", "left_semi"))


def url_inventory(page_index: DataFrame, emitted: DataFrame, completed: DataFrame, failed: DataFrame, run_id: Column, categories: list[str] | None = None) -> DataFrame:
    """A row of 29 columns for each address of any source."""
    none = F.array().cast("array<string>")
    rest = F.struct(*(c for c in page_index.columns if c != "url"))
    order = F.struct("position", rest) if "position" in page_index.columns else rest
    entry = page_index.filter(_given("url").isNotNull() & _parseable() & in_categories(categories)).select("url", rest.alias("e"), order.alias("e_order"))
    made = emitted_rows(emitted, page_index, categories).select("url", "category", "item", F.struct("file_order", "category").alias("made_order"))
    done = completed.select("url", F.lit(True).alias("in_completed"))
    errors = failed.select("url", F.col("error").alias("fetch_error"), F.lit(True).alias("in_failed"))
    # every source is tagged by its own columns; one shuffle brings an address together
    tagged = entry.unionByName(made, True).unionByName(done, True).unionByName(errors, True)
    r = tagged.groupBy("url").agg(
        F.max_by("e", "e_order").alias("e"), F.array_sort(F.collect_set("category")).alias("emitted_categories"), F.count("made_order").alias("n_emitted"),
        F.min_by("item", "made_order").alias("item"), F.max("in_completed").alias("in_completed"), F.min("fetch_error").alias("fetch_error"), F.max("in_failed").alias("in_failed"),
    )
    found, parsed = F.col("e").isNotNull() | F.col("item").isNotNull() | F.col("in_completed").isNotNull(), F.col("item").isNotNull()
    e, item, cats = F.col("e"), F.col("item"), F.coalesce("emitted_categories", none)
    first = F.get(cats, F.lit(0))
    hashed = text.sha256(F.col("url"))
    missing = F.lit(None).cast("string")
    return r.select(
        "url", F.col("url").alias("url_normalized"), hashed.alias("url_hash"), text.doc_id(F.col("url")).alias("doc_id"),
        (found | F.col("in_failed").isNotNull()).alias("discovered"), found.alias("fetched"), parsed.alias("parsed"),
        (parsed & ~F.array_contains(cats, "unresolved")).alias("resolved"), parsed.alias("emitted"),
        text.status_code(F.col("fetch_error")).alias("http_status"), "fetch_error", missing.alias("parse_error"),
        e.page_state.alias("page_state"), F.coalesce(e.crawl_sources, none).alias("crawl_sources"), none.alias("source_urls"),
        e.provisional_category.alias("provisional_category"),
        F.coalesce(F.nullif(e.resolved_category, F.lit("")), F.when(first != "unresolved", first)).alias("resolved_category"),
        F.coalesce(F.nullif(e.resolution_confidence, F.lit("")), item.resolution_confidence).alias("resolution_confidence"),
        F.coalesce(F.when(F.size(e.resolution_evidence) > 0, e.resolution_evidence), item.resolution_evidence, none).alias("resolution_evidence"),
        item["name"].alias("title"), F.coalesce(item.breadcrumbs, none).alias("breadcrumbs"), item.subcategory.alias("subcategory"),
        e.filepath.alias("raw_html_path"), F.char_length(F.trim(F.coalesce(item.description, F.lit("")))).alias("text_length"),
        missing.alias("content_hash"), F.coalesce(F.col("n_emitted") > 1, F.lit(False)).alias("is_duplicate"), missing.alias("duplicate_of"),
        cats.alias("emitted_categories"), run_id.alias("run_id"),
    )


def coverage_totals(inventory: DataFrame) -> DataFrame:
    """The eight totals of a run."""
    failed = F.coalesce(F.col("fetch_error") != "", F.lit(False))
    metrics = {"discovered": F.col("discovered"), "fetched": F.col("fetched"), "failed": failed, "parsed": F.col("parsed"), "resolved": F.col("resolved"), "unresolved": F.col("parsed") & ~F.col("resolved"), "emitted": F.col("emitted"), "duplicates": F.col("is_duplicate")}
    return coverage(inventory, [], metrics)


def category_coverage(inventory: DataFrame) -> DataFrame:
    """The seven counts of each category."""
    category = F.coalesce(_given("resolved_category"), _given("provisional_category"), F.lit("unresolved")).alias("category")
    failed = F.coalesce(F.col("fetch_error") != "", F.lit(False))
    metrics = {"discovered": F.col("discovered"), "fetched": F.col("fetched"), "parsed": F.col("parsed"), "resolved": F.col("resolved"), "emitted": F.col("emitted"), "failed": failed, "thin_content": F.col("emitted") & (F.col("text_length") < 80)}
    return coverage(inventory, [category], metrics).drop("total")


def thin_content(inventory: DataFrame) -> DataFrame:
    """Emitted records of fewer than 80 characters."""
    return inventory.filter("emitted and text_length < 80").select("url", "title", "resolved_category", "text_length", F.lit("thin_content").alias("reason"))


def discovery_gaps(inventory: DataFrame, completed: DataFrame, page_index: DataFrame) -> DataFrame:
    """(url, reason): fetched without an index entry, or parseable without a record."""
    lost = completed.select("url").distinct().join(page_index.select("url"), "url", "left_anti").withColumn("reason", F.lit("completed_without_page_index"))
    silent = inventory.filter(F.col("fetched") & ~F.col("parsed") & F.col("page_state").isin("content", "hybrid")).select("url", F.lit("parseable_not_emitted").alias("reason"))
    return lost.unionByName(silent)


def audit_details(page_index: DataFrame, emitted: DataFrame, completed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(severity, type, url, expected_category, categories) of all six anomalies."""
    own = F.col("resolved_category"), F.col("category")
    want = expected(page_index, categories).select("url", effective_category(*own).alias("expected_category"), expected_categories(*own, F.col("crawl_sources")).alias("allowed"))
    have = emitted_rows(emitted, page_index, categories).groupBy("url").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    both = want.join(have, "url", "full")
    first = F.get("categories", F.lit(0))
    only_unresolved = (F.size("categories") == 1) & (first == "unresolved")
    orphan = F.col("expected_category").isNull() & (F.lit(True) if not categories else ~only_unresolved)
    met = F.col("expected_category").isNotNull() & F.col("categories").isNotNull()
    mismatch = met & (first != "unresolved") & (F.size("allowed") > 0) & ~F.array_contains(F.col("allowed"), first)
    rules = [
        ("hard", "missing_from_json", F.col("categories").isNull()),
        ("hard", "orphan_json", orphan),
        ("hard", "duplicate_url_across_files", met & (F.size("categories") > 1)),
        ("hard", "category_mismatch", mismatch),
        ("warn", "unresolved_items", met & (first == "unresolved")),
    ]
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"))) for s, t, c in rules)), lambda h: h.isNotNull())
    found = both.select("url", "expected_category", "categories", F.inline(hits))
    if not categories:
        lost = completed.select("url").distinct().join(page_index.select("url"), "url", "left_anti")
        found = found.unionByName(lost.select("url", F.lit("warn").alias("severity"), F.lit("completed_without_page_index").alias("type")), allowMissingColumns=True)
    return found.select("severity", "type", "url", "expected_category", "categories")


def counts_of(rows: DataFrame, members: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, n): in how many rows each of ``keys`` is among ``members``; 0 for those in
    none (E15)."""
    counted = rows.select(F.explode(members).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return keys.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
