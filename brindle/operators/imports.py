"""Import of canonical documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators.chunks import build_chunks
from brindle.operators.mutations import last_of, snapshot, swap, upsert
from brindle.sources import schemas

# Names of missing things; versions written to the rows where none are given.
UNTITLED, GENERAL, SCRAPER, PARSER = "Untitled Rule", "general", "scraper_v3", "export_embeddings_v1"


LEDGER = "stream string, batch_id long"


def _given(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _title() -> Column:
    return F.trim(F.coalesce(_given("title"), _given("doc_id"), F.lit(UNTITLED)))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    """A column as ``kind``, null where the table has none of that name."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _list(df: DataFrame, name: str, kind: str = "array<string>") -> Column:
    return F.coalesce(_column(df, name, kind), F.array().cast(kind))


def _json(**fields: Column) -> Column:
    """An object of all fields, also of those that are null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def _pairs(docs: DataFrame) -> Column:
    """properties as an object: a label's last value counts."""
    if "properties" not in docs.columns:
        return F.create_map().cast("map<string,string>")
    given = F.coalesce("properties", F.array().cast(docs.schema["properties"].dataType))
    labels = F.array_distinct(F.transform(given, lambda p: p["k"].cast("string")))
    last = lambda k: F.element_at(F.filter(given, lambda p: p["k"].cast("string") == k), -1)["v"].cast("string")
    return F.map_from_arrays(labels, F.transform(labels, last))


def page_rows(docs: DataFrame, snapshot_at: Column, scraper: str = SCRAPER, parser: str = PARSER) -> DataFrame:
    """A page row for each canonical document (C17), with its metadata as JSON.  The version
    is always 1: versions that count on are sync_rules."""
    content = F.trim(F.coalesce("embedding_text", F.lit("")))
    slug = F.coalesce(_given("doc_id"), text.slug(F.coalesce(_given("url"), _given("title"), F.lit("rule-page")), "rule-page"))
    text_of = lambda name: F.nullif(_column(docs, name, "string"), F.lit(""))
    extensions = F.coalesce("extensions", F.array().cast(docs.schema["extensions"].dataType)) if "extensions" in docs.columns else F.array().cast("array<string>")
    length = F.coalesce(F.nullif(_column(docs, "embedding_text_length", "int"), F.lit(0)), F.char_length(content))
    metadata = _json(
        breadcrumbs=_list(docs, "breadcrumbs"), crawl_sources=_list(docs, "crawl_sources"), resolution_evidence=_list(docs, "resolution_evidence"),
        properties=_pairs(docs), description=F.coalesce(_column(docs, "description", "string"), F.lit("")), extensions=extensions,
        raw_html_path=text_of("raw_html_path"), embedding_text_length=length,
    )
    return docs.select(
        text.sha256(F.col("doc_id")).alias("id"), "doc_id", text_of("source_item_id").alias("source_item_id"), F.col("url").alias("source_url"),
        F.coalesce(_given("url_hash"), text.sha256(F.coalesce("url", F.lit("")))).alias("url_hash"), slug.alias("canonical_slug"),
        _title().alias("title"), F.trim(F.coalesce(_given("category"), F.lit(GENERAL))).alias("category"), _given("resolved_category").alias("resolved_category"),
        text_of("subcategory").alias("subcategory"), _given("page_state").alias("page_state"), F.coalesce("is_unresolved", F.lit(False)).alias("is_unresolved"),
        text_of("resolution_confidence").alias("resolution_confidence"), content.alias("normalized_content"),
        text.sha256(content).alias("content_hash"), F.lit(parser).alias("parser_version"), F.lit(scraper).alias("scraper_version"), snapshot_at.alias("source_snapshot_at"),
        F.lit(1).alias("version"), metadata.alias("metadata"), snapshot_at.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def chunk_rows(chunks: DataFrame, pages: DataFrame, model: str | None = None, at: Column | None = None) -> DataFrame:
    """A chunk row for each chunk, with its page's id and version; an error for a chunk
    without a page (D4).

    A chunk's vector is its column ``embedding`` where there is one; rows that have it tell
    ``model`` and when (``at``) it was made."""
    owners = pages.select("doc_id", F.col("id").alias("page_id"), F.coalesce("version", F.lit(1)).alias("version"))
    met = chunks.join(owners, "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("missing page row for doc_id "), F.coalesce("doc_id", F.lit("null")))).cast("string")
    text_of = lambda name: F.nullif(_column(met, name, "string"), F.lit(""))
    vector = _column(met, "embedding", "array<float>")
    metadata = _json(source_item_id=text_of("source_item_id"), page_state=text_of("page_state"), resolution_confidence=text_of("resolution_confidence"), breadcrumbs=_list(met, "breadcrumbs"))
    return met.select(
        "chunk_id", F.when(F.col("page_id").isNull(), missing).otherwise(F.col("page_id")).alias("page_id"), "version", "chunk_index", _given("title").alias("title"),
        F.trim(F.coalesce(_given("category"), F.lit(GENERAL))).alias("category"), text_of("resolved_category").alias("resolved_category"), _given("title").alias("heading"),
        F.trim(F.coalesce("chunk_text", F.lit(""))).alias("chunk_text"), "char_start", "char_end", F.coalesce("is_unresolved", F.lit(False)).alias("is_unresolved"),
        metadata.alias("metadata"), vector.alias("embedding"), F.when(vector.isNotNull(), F.lit(model)).cast("string").alias("embedding_model"),
        F.when(vector.isNotNull(), at if at is not None else F.lit(None)).cast("timestamp").alias("embedded_at"), F.lit(True).alias("is_active"),
    )


def sync_rules(docs: DataFrame, chunks: DataFrame, pages_table: DataFrame, chunks_table: DataFrame, snapshot_at: Column, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The next snapshots of pages and chunks after a later run (P12); write both with one
    mutations.swap.

    A page whose content hash is unchanged stays as it is, chunks and vectors included, and
    lives again if it was gone; a changed one counts its version on, its chunks of the same
    ids are replaced, its others deactivated; new pages begin at version 1; pages that
    disappeared are marked deleted and their chunks deactivated.  Tables need the
    columns of page_rows and chunk_rows, docs a row for each doc_id; new chunks that
    have no vector are those that pending_vectors gives."""
    fresh = page_rows(docs, snapshot_at)
    names = pages_table.columns
    old = pages_table.select(F.col("doc_id"), F.struct(*names).alias("old"))
    new = fresh.select(F.col("doc_id"), F.struct(*(c for c in names)).alias("new"))
    j = old.join(new, "doc_id", "full")
    gone, added = F.col("new").isNull(), F.col("old").isNull()
    same = ~gone & ~added & F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    state = F.when(gone, "gone").when(added, "added").when(same, "same").otherwise("changed")
    j = j.withColumn("state", state)

    def field(c: str) -> Column:
        kept, came = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c == "version":
            came = F.when(F.col("state") == "changed", F.coalesce(F.col("old.version"), F.lit(1)) + 1).otherwise(came)
        if c == "id":
            came = F.coalesce(kept, came)
        if c == "deleted_at":
            kept = F.when(F.col("state") == "gone", F.coalesce(kept, snapshot_at.cast(pages_table.schema[c].dataType)))
        if c == "last_seen_at":
            kept = F.when(F.col("state") == "same", came).otherwise(kept)
        return F.when(F.col("state").isin("gone", "same"), kept).otherwise(came).alias(c)

    pages = j.select(*(field(c) for c in names))
    states = j.select(F.coalesce("old.id", "new.id").alias("page_id"), "doc_id", "state", F.col("old.deleted_at").isNotNull().alias("was_gone"), F.coalesce("old.version", F.lit(1)).alias("page_version"))
    rewritten = states.filter("state in ('added', 'changed')")
    made = chunk_rows(chunks.join(rewritten.select("doc_id"), "doc_id", "left_semi"), pages, model, snapshot_at).select(*chunks_table.columns)
    left = chunks_table.join(made.select("chunk_id"), "chunk_id", "left_anti").join(states.select("page_id", "state", "was_gone", "page_version"), "page_id", "left")
    back = (F.col("state") == "same") & F.col("was_gone") & F.col("version").eqNullSafe(F.col("page_version"))
    active = F.when(F.col("state").isin("gone", "changed"), False).when(back, True).otherwise(F.col("is_active"))
    return pages, left.withColumn("is_active", active).select(*chunks_table.columns).unionByName(made)


def pending_vectors(chunks_table: DataFrame) -> DataFrame:
    """Active chunks that have no vector yet: (chunk_id, chunk_text)."""
    return chunks_table.filter("is_active and embedding is null").select("chunk_id", "chunk_text")


def import_structured(docs: DataFrame, chunks: DataFrame, pages_table: DataFrame, chunks_table: DataFrame, snapshot_at: Column, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The next snapshots of pages (by doc_id) and chunks (by chunk_id): last writer wins."""
    pages = upsert(pages_table, page_rows(docs, snapshot_at).select(*pages_table.columns), ["doc_id"])
    rows = chunk_rows(chunks, pages, model, snapshot_at).select(*chunks_table.columns)
    return pages, upsert(chunks_table, rows, ["chunk_id"])


def import_batch(folder: str, docs: DataFrame, batch_id: int, snapshot_at: Column, name: str = "import", order: str = "url") -> bool:
    """Imports one batch of a stream of canonical documents exactly once (P11, B3, B5); for
    foreachBatch.  False if the batch was there already, which then changes nothing.

    Pages, their chunks and a ledger of the batches of each stream are the tables of one
    snapshot in ``folder``, made present by one rename: a batch that was cut off leaves
    nothing, one that is given again finds itself in the ledger.  Of a batch's
    documents of one doc_id the greatest by ``order`` counts."""
    spark = docs.sparkSession
    held = {t: snapshot(spark, folder, t, kind) for t, kind in (("rule_pages", schemas.TABLES["rule_pages"]), ("rule_chunks", schemas.TABLES["rule_chunks"]), ("ledger", LEDGER))}
    if not held["ledger"].filter((F.col("stream") == name) & (F.col("batch_id") == batch_id)).isEmpty():
        return False
    own = last_of(docs, ["doc_id"], order)
    given = [c for c in ("doc_id", "title", "category", "resolved_category", "is_unresolved", "source_item_id", "page_state", "resolution_confidence", "breadcrumbs") if c in own.columns]
    cut = build_chunks(own, "doc_id", "embedding_text").join(own.select(*given), "doc_id")
    pages, rows = import_structured(own, cut, held["rule_pages"], held["rule_chunks"], snapshot_at)
    ledger = held["ledger"].union(spark.createDataFrame([(name, batch_id)], LEDGER))
    swap({"rule_pages": pages, "rule_chunks": rows, "ledger": ledger}, folder)
    return True


def legacy_rows(docs: DataFrame, chunks: DataFrame, snapshot_at: Column | None = None, scraper: str = SCRAPER) -> DataFrame:
    """(title, content, category, source_url, chunk_id, metadata) of each chunk: the title
    says which part of how many it is, and a title that several documents have also
    which document (F9).  An error for a chunk without a document or without doc_id."""
    at = snapshot_at.cast("string") if snapshot_at is not None else F.lit(None).cast("string")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_parts"))
    titles = docs.select(_title().alias("__title")).groupBy("__title").agg(F.count("*").alias("n_titles"))
    named = docs.withColumn("__title", _title()).join(titles, "__title").select(F.col("doc_id").alias("__doc"), F.struct("__title", "n_titles", *docs.columns).alias("d"))
    met = chunks.select("doc_id", F.struct(*chunks.columns).alias("c")).join(counts.withColumnRenamed("doc_id", "__of"), F.col("doc_id").eqNullSafe(F.col("__of"))).join(named, F.col("doc_id") == F.col("__doc"), "left")
    d = lambda name, kind="string": (F.col(f"d.{name}") if name in docs.columns else F.lit(None)).cast(kind)
    c = lambda name, kind="string": (F.col(f"c.{name}") if name in chunks.columns else F.lit(None)).cast(kind)
    said = lambda *columns: F.coalesce(*(F.nullif(x, F.lit("")) for x in columns))
    index, none = F.coalesce(c("chunk_index", "int"), F.lit(0)), F.array().cast("array<string>")
    missing = F.raise_error(F.concat(F.lit("missing canonical document for chunk "), F.coalesce(c("chunk_id"), F.lit("null")))).cast("string")
    part = F.when(F.col("n_parts") > 1, F.format_string(" (part %d/%d)", index + 1, F.col("n_parts"))).otherwise("")
    title = F.concat(F.col("d.__title"), part, F.when(F.col("d.n_titles") > 1, F.format_string(" [%s]", F.col("doc_id"))).otherwise(""))
    metadata = _json(
        imported_from=F.lit(scraper), doc_id=F.col("doc_id"), chunk_id=c("chunk_id"), source_item_id=said(d("source_item_id"), c("source_item_id")), chunk_index=index, total_chunks=F.col("n_parts").cast("int"),
        resolved_category=said(d("resolved_category"), c("resolved_category")), subcategory=said(d("subcategory")), page_state=said(d("page_state"), c("page_state")),
        is_unresolved=F.coalesce(d("is_unresolved", "boolean"), F.lit(False)) | F.coalesce(c("is_unresolved", "boolean"), F.lit(False)), resolution_confidence=said(d("resolution_confidence"), c("resolution_confidence")),
        breadcrumbs=F.coalesce(d("breadcrumbs", "array<string>"), c("breadcrumbs", "array<string>"), none), crawl_sources=F.coalesce(d("crawl_sources", "array<string>"), none), raw_html_path=said(d("raw_html_path")),
        char_start=c("char_start", "int"), char_end=c("char_end", "int"), source_snapshot_at=at,
    )
    category = F.trim(F.coalesce(said(d("resolved_category"), d("category"), c("resolved_category"), c("category")), F.lit(GENERAL)))
    return met.select(F.when(F.col("d").isNull(), missing).otherwise(title).alias("title"), F.trim(F.coalesce(c("chunk_text"), F.lit(""))).alias("content"), category.alias("category"), d("url").alias("source_url"), c("chunk_id").alias("chunk_id"), metadata.alias("metadata"))


def import_legacy(docs: DataFrame, chunks: DataFrame, table: DataFrame) -> DataFrame:
    """The next snapshot of the legacy table, by title and source."""
    keys = ["title", "source_url"]
    return upsert(table, last_of(legacy_rows(docs, chunks), keys, "chunk_id").select(*table.columns), keys)


def run_import(docs: DataFrame, chunks: DataFrame, structured: tuple[DataFrame, DataFrame] | None, legacy: DataFrame | None, snapshot_at: Column, include_unresolved: bool = False) -> dict[str, DataFrame]:
    """The tables to write: of the structured import where its tables exist, else of the
    legacy one (P11).  Unresolved documents go first unless asked for, and with them
    their chunks (D7)."""
    kept = docs if include_unresolved else docs.filter(~F.coalesce("is_unresolved", F.lit(False)))
    own = chunks.join(kept.select("doc_id"), "doc_id", "left_semi")
    if structured is not None:
        pages, rows = import_structured(kept, own, *structured, snapshot_at)
        return {"rule_pages": pages, "rule_chunks": rows}
    if legacy is None:
        raise ValueError("neither the structured tables nor the legacy table exist")
    return {"rule_documents": import_legacy(kept, own, legacy)}
