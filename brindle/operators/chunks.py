"""Chunking and document export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import addresses
from brindle.functions import text as texts

# Characters of a chunk, and shared by neighbours of a hard split.
MAX_CHARS, OVERLAP = 1400, 200
PIECE = "struct<text:string,start:int,end:int>"


def hard_split(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array<struct<text, start, end>> of overlapping windows, in closed form."""
    step = max(max_chars - overlap, 1)
    n = F.char_length(text)
    count = F.when(n <= max_chars, 1).otherwise(F.ceil((n - max_chars) / step) + 1).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(F.substr(text, i * step + 1, F.lit(max_chars)).alias("text"), (i * step).alias("start"), F.least(i * step + max_chars, n).alias("end")),
    )


def pack(text: Column, separator: str = "\n\n", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array<struct<text, start, end>>: paragraphs packed greedily up to max_chars.

    A paragraph is stripped; empty ones go.  One that is too long alone is split
    hard, and nothing is packed onto its pieces.  Offsets are of the source text.
    A null text gives an empty array.

    A fold over the paragraphs' lengths alone finds where chunks begin and end; texts are
    cut and joined once, when all ends are known, so the cost is linear in the text.
    """
    gap = len(separator)
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    # a chunk: its first and last paragraph, its place in the text, and whether it is too long alone
    kind = "struct<first:int,last:int,start:int,end:int,size:int,long:boolean>"
    chunk = lambda first, last, start, end, size, long: F.struct(first.alias("first"), last.alias("last"), start.alias("start"), end.alias("end"), size.alias("size"), long.alias("long")).cast(kind)
    none = F.lit(None).cast(kind)

    def measured(p: Column, i: Column) -> Column:
        lead = F.char_length(p) - F.char_length(F.regexp_replace(p, r"^\s+", ""))
        return F.struct(i.alias("i"), F.char_length(p).alias("n"), lead.alias("lead"), F.char_length(bare(p)).alias("size"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p.lead
        own = chunk(p.i, p.i, start, start + p.size, p.size, p.size > max_chars)
        # null while no chunk is open
        fits = F.coalesce((p.size <= max_chars) & (a.open["size"] + gap + p.size <= max_chars), F.lit(False))
        more = chunk(a.open["first"], p.i, a.open["start"], start + p.size, a.open["size"] + gap + p.size, F.lit(False))
        done = lambda: F.when(a.open.isNull(), a.out).otherwise(F.array_append(a.out, a.open))
        out = F.when((p.size == 0) | fits, a.out).when(p.size > max_chars, F.array_append(done(), own)).otherwise(done())
        open_one = F.when(p.size == 0, a.open).when(fits, more).when(p.size > max_chars, none).otherwise(own)
        return F.struct((a["at"] + p.n + gap).cast("int").alias("at"), open_one.alias("open"), out.alias("out"))

    def cut(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("open"), F.array().cast(f"array<{kind}>").alias("out"))
        ends = F.aggregate(F.transform(pieces, measured), zero, step, lambda a: F.when(a.open.isNull(), a.out).otherwise(F.array_append(a.out, a.open)))
        joined = lambda c: F.array_join(F.filter(F.transform(F.slice(pieces, c["first"] + 1, c["last"] - c["first"] + 1), bare), lambda t: t != ""), separator)
        whole = lambda c: F.array(F.struct(joined(c).alias("text"), c.start.alias("start"), c.end.alias("end")))
        split = lambda c: F.transform(hard_split(bare(F.get(pieces, c["first"])), max_chars, overlap), lambda h: F.struct(h.text.alias("text"), (c.start + h.start).cast("int").alias("start"), (c.start + h.end).cast("int").alias("end")))
        return F.flatten(F.transform(ends, lambda c: F.when(c.long, split(c)).otherwise(whole(c)).cast(f"array<{PIECE}>")))

    return F.coalesce(addresses.let(F.split(text, separator, -1), cut), F.array().cast(f"array<{PIECE}>"))


def build_chunks(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """A row for each chunk: key, chunk_index, chunk_id, text, start, end.

    A document whose text has no paragraph is one chunk of its whole text."""
    whole = F.array(F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(0).alias("start"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("end")))
    packed = docs.select(key, pack(F.col(text), **options).alias("__chunks"), whole.alias("__whole"))
    rows = packed.select(key, F.posexplode(F.when(F.size("__chunks") > 0, F.col("__chunks")).otherwise(F.col("__whole"))).alias("chunk_index", "__c"))
    return rows.select(key, "chunk_index", chunk_id(F.col(key), F.col("chunk_index")).alias("chunk_id"), F.col("__c.text").alias("chunk_text"), F.col("__c.start").alias("char_start"), F.col("__c.end").alias("char_end"))


def chunk_id(key: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%03d", key.cast("string"), index)


def legacy_chunks(text: Column, max_tokens: int = 1500, least: int = 100) -> Column:
    """array<string>: sections of a markdown text packed up to an estimate of tokens
    (1.3 a word, counted once a section); trimmed chunks of ``least`` characters or
    fewer go (T5).  A section that does not start with # gets its heading's marks back."""
    sections = F.transform(F.split(text, "\n## ", -1), lambda p: F.when(p.startswith("#"), p).otherwise(F.concat(F.lit("## "), p)))
    tokens = lambda p: F.size(F.split(p, r"\s+", -1)) * 1.3
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    # closed chunks, the open one, and the tokens it has
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0.0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (a.n + tokens(p) > max_tokens) & (a.open != "")
        fresh = F.struct(F.array_append(a.done, a.open).alias("done"), p.alias("open"), tokens(p).alias("n"))
        return F.when(full, fresh).otherwise(F.struct(a.done.alias("done"), F.concat(a.open, F.lit("\n"), p).alias("open"), (a.n + tokens(p)).alias("n")))

    packed = F.aggregate(sections, zero, step, lambda a: F.array_append(a.done, a.open))
    return F.filter(F.transform(packed, trim), lambda c: F.char_length(c) > least)


def exclude_reason(name: Column, breadcrumbs: Column, properties: Column, description: Column, extensions: Column) -> Column:
    """Why a document is not embedded (C14): it is if any of its parts says anything,
    whether it is resolved or not.  properties and extensions come flattened."""
    said = F.exists(F.array(name, properties, description, extensions, F.array_join(breadcrumbs, "")), lambda c: F.coalesce(F.regexp_replace(c, r"\s+", ""), F.lit("")) != "")
    return F.when(~said, "no_informational_text")


def canonical_documents(inventory: DataFrame, emitted: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Documents of 22 columns (T4): inventory rows with their first record; addresses
    without a record go, and so do other categories than those asked for, except
    unresolved ones.

    ``emitted`` is (url, category, file_order, item), item with id, name, category,
    breadcrumbs, subcategory, properties (array<struct<k, v>>), description, extensions."""
    first = emitted.groupBy("url").agg(F.min_by(F.struct("category", "item"), F.struct("file_order", "category")).alias("first"))
    d = inventory.filter(F.coalesce(F.col("url"), F.lit("")) != "").join(first, "url").withColumn("__own", F.col("first.category"))
    if categories:
        d = d.filter(F.col("__own").isin(*categories, "unresolved"))
    i, none = F.col("first.item"), F.array().cast("array<string>")
    crumbs = F.coalesce(i.breadcrumbs, none)
    parts = texts.flattened(i.properties), texts.flattened_extensions(i.extensions)
    body = texts.embedding_text(i["name"], i.category, crumbs, i.subcategory, parts[0], i.description, parts[1])
    reason = exclude_reason(i["name"], crumbs, parts[0], i.description, parts[1])
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(None).cast("string"))
    out = d.select(
        F.coalesce(blank(F.col("doc_id")), texts.doc_id(F.col("url"))).alias("doc_id"), i.id.alias("source_item_id"), "url",
        F.coalesce(blank(F.col("url_hash")), texts.sha256(F.col("url"))).alias("url_hash"), F.coalesce(i["name"], F.lit("")).alias("title"),
        F.coalesce(blank(i.category), F.col("__own")).alias("category"), "resolved_category",
        (F.coalesce(i.category == "unresolved", F.lit(False)) | blank(F.col("resolved_category")).isNull()).alias("is_unresolved"),
        crumbs.alias("breadcrumbs"), i.subcategory.alias("subcategory"), "page_state",
        F.coalesce(blank(F.col("resolution_confidence")), i.resolution_confidence).alias("resolution_confidence"),
        F.coalesce(F.when(F.size("resolution_evidence") > 0, F.col("resolution_evidence")), i.resolution_evidence, none).alias("resolution_evidence"),
        i.properties.alias("properties"), F.coalesce(i.description, F.lit("")).alias("description"), i.extensions.alias("extensions"),
        F.coalesce("crawl_sources", none).alias("crawl_sources"), "raw_html_path", body.alias("embedding_text"), reason.alias("exclude_reason"),
    )
    return out.withColumn("embedding_text_length", F.char_length("embedding_text")).withColumn("embeddable", F.col("exclude_reason").isNull())
