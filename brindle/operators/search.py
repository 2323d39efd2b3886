"""Vector, title and hybrid search.

Vectors are compared exactly: filters come before the ranking, each row's norm is
computed once, and a top-k never sorts more than k rows of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.functions.vector import dot, literal, norm

# Defaults of the searches.
LIMIT, THRESHOLD = 3, 0.5
#: Queries sent to the tasks at once.
BLOCK = 4096


def match_chunks(chunks: DataFrame, query: list[float], threshold: float = THRESHOLD, limit: int | None = LIMIT, category: str | None = None, include_unresolved: bool = True, *, vector: str = "embedding", key: str = "vec_id", category_col: str = "label") -> DataFrame:
    """The ``limit`` rows most similar to ``query``, at or above ``threshold``; ties by key.

    Without a limit all such rows, in no order."""
    rows = chunks.filter(F.col(vector).isNotNull())
    if category is not None:
        rows = rows.filter(F.col(category_col) == category)
    if not include_unresolved:
        rows = rows.filter(~F.col("is_unresolved"))
    length = sum(x * x for x in query) ** 0.5
    found = rows.withColumn("similarity", F.try_divide(dot(F.col(vector), literal(query)), norm(F.col(vector)) * length))
    found = found.filter(F.col("similarity") >= threshold)
    return found if limit is None else found.orderBy(F.desc("similarity"), key).limit(limit)


def match_many(queries: DataFrame, chunks: DataFrame, limit: int, *, query_key: str = "query_id", vector: str = "embedding", key: str = "vec_id", exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """The ``limit`` rows nearest to every query of a stated set (D8), among all rows: each
    block of at most ``block`` queries is sent to the tasks for one scan of the rows.

    A task keeps the best of its rows for each query, so what shuffles is at most
    ``limit`` rows for each query and task.  Vectors that are null or zero, and ties, are
    as in match_chunks."""
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {chunks.schema[key].dataType.simpleString()}, similarity double"
    rows = chunks.filter(F.col(vector).isNotNull()).select(key, vector)
    asked = queries.filter(F.col(vector).isNotNull()).select(query_key, vector)
    found, held = None, []

    def part(some: list) -> DataFrame:
        sent = chunks.sparkSession.sparkContext.broadcast(([r[query_key] for r in some], np.asarray([r[vector] for r in some], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            q = q / np.where((size := np.linalg.norm(q, axis=1, keepdims=True)) > 0, size, np.nan)
            best: list[list[tuple[float, object]]] = [[] for _ in ids]
            for batch in batches:
                keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
                v = np.asarray(batch.column(batch.schema.get_field_index(vector)).to_pylist(), dtype=np.float64).reshape(len(keys), -1)
                size = np.linalg.norm(v, axis=1)
                scores = q @ (v / np.where(size > 0, size, np.nan)[:, None]).T
                for i, row in enumerate(scores):
                    good = np.flatnonzero(~np.isnan(row))
                    if len(good) > limit:
                        cut = np.partition(row[good], -limit - 1)[-limit - 1]
                        good = good[row[good] >= cut]
                    new = [(-float(row[j]), keys[j]) for j in good.tolist() if not (exclude_self and keys[j] == ids[i])]
                    best[i] = sorted(best[i] + new)[:limit]
            out = [(ids[i], k, -s) for i, b in enumerate(best) for s, k in b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to_arrow_schema(wanted), strict=True)], [query_key, key, "similarity"])

        return rows.mapInArrow(run, schema)

    wanted = T.StructType([queries.schema[query_key], chunks.schema[key], T.StructField("similarity", T.DoubleType())])
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            found, held = part(held) if found is None else found.unionByName(part(held)), []
    if held or found is None:
        found = chunks.sparkSession.createDataFrame([], schema) if not held and found is None else part(held) if found is None else found.unionByName(part(held))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def best_per_page(rows: DataFrame, page: str, score: str, key: str) -> DataFrame:
    """The best row of each page; each task cuts its pages' rows before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(page).orderBy(F.desc(score), key))).filter("__rank = 1").drop("__rank")


def title_tier(title: Column, term: str) -> Column:
    """1 exact, 2 prefix, 3 contained, null otherwise; case does not count."""
    low, t = F.lower(title), term.lower()
    return F.when(low == t, 1).when(low.startswith(t), 2).when(low.contains(t), 3)


def rank_titles(rows: DataFrame, title: str, term: str, key: str, limit: int | None = LIMIT) -> DataFrame:
    """Rows whose title matches ``term``, by tier, then key."""
    found = rows.withColumn("tier", title_tier(F.col(title), term)).filter("tier is not null")
    return found.orderBy("tier", key).limit(limit) if limit else found


def over_fetch(limit: int, include_unresolved: bool = False) -> int:
    return limit if include_unresolved else max(3 * limit, limit + 5)


def hybrid(exact: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Title hits first, then semantic hits that are no title hits; unique by key."""
    tagged = exact.withColumn("source", F.lit("exact")).unionByName(semantic.join(exact, key, "left_anti").withColumn("source", F.lit("semantic")), allowMissingColumns=True)
    return tagged


def by_category(rows: DataFrame, column: str, value: str, order: list[str], limit: int) -> DataFrame:
    return rows.filter(F.col(column) == value).orderBy(*order).limit(limit)


def first_ilike(rows: DataFrame, column: str, term: str, key: str) -> DataFrame:
    """The first row by key whose column contains ``term``, case aside."""
    return rows.filter(F.col(column).ilike(f"%{term}%")).orderBy(key).limit(1)


def autocomplete(rows: DataFrame, column: str, term: str, limit: int = 25, prefix: bool = False) -> DataFrame:
    """Distinct values that contain (or start with) a term, in order."""
    low = F.lower(F.col(column))
    hit = low.startswith(term.lower()) if prefix else low.contains(term.lower())
    return rows.filter(hit).select(column).distinct().orderBy(column).limit(limit)


def match_rule_chunks(chunks: DataFrame, pages: DataFrame, query: list[float], threshold: float = THRESHOLD, limit: int | None = LIMIT, category: str | None = None, include_unresolved: bool = False) -> DataFrame:
    """The chunks of living pages most similar to ``query`` (S1, K1), ties by chunk_id.

    chunks: chunk_id, page_id, chunk_text, embedding, is_active.  pages: page_id, doc_id,
    title, category, resolved_category, source_url, is_unresolved, deleted_at.  All
    conditions come before the join and the ranking; unresolved pages are left out
    unless asked for."""
    live = pages.filter(F.col("deleted_at").isNull())
    if category is not None:
        live = live.filter(F.col("category") == category)
    if not include_unresolved:
        live = live.filter(~F.col("is_unresolved"))
    live = live.select("page_id", "doc_id", "title", "category", "resolved_category", "source_url")
    active = chunks.filter(F.col("is_active")).select("chunk_id", "page_id", "chunk_text", "embedding")
    near = match_chunks(active, query, threshold, None).drop("embedding")
    found = near.join(live, "page_id")
    return found if limit is None else found.orderBy(F.desc("similarity"), "chunk_id").limit(limit)


def normalised(found: DataFrame) -> DataFrame:
    """Search results with what is missing filled in: no text is '', the category stands
    for a resolved one that is not there."""
    return found.withColumn("chunk_text", F.coalesce("chunk_text", F.lit(""))).withColumn("resolved_category", F.coalesce(F.nullif("resolved_category", F.lit("")), "category"))


def search_rules(structured: tuple[DataFrame, DataFrame] | None, legacy: DataFrame | None, query: list[float] | None, threshold: float = THRESHOLD, limit: int = LIMIT, category: str | None = None, include_unresolved: bool = False) -> DataFrame | None:
    """The ``limit`` best chunks (S2) of the tables (chunks, pages) where they exist, else
    of the legacy table (chunk_id, doc_id, title, category, resolved_category,
    source_url, chunk_text, embedding, is_unresolved); None where there is neither table
    or no query.

    More are fetched than asked for, as the legacy table's unresolved rows go later."""
    if not query or (structured is None and legacy is None):
        return None
    more = over_fetch(limit, include_unresolved)
    if structured is not None:
        found = match_rule_chunks(*structured, query, threshold, more, category, include_unresolved)
    else:
        found = match_chunks(legacy, query, threshold, more, category, key="chunk_id", category_col="category")
        found = found if include_unresolved else found.filter(~F.coalesce("is_unresolved", F.lit(False)))
        found = found.drop("embedding", "is_unresolved").withColumn("page_id", F.lit(None).cast("string"))
    return normalised(found).orderBy(F.desc("similarity"), "chunk_id").limit(limit)


def distinct_pages(found: DataFrame, limit: int) -> DataFrame:
    """The first chunk of each page in order of similarity, at most ``limit`` (F1): a row
    goes if its page_id or its doc_id was that of a row kept before.

    ``found`` is a search result, so a few rows; they meet in one array."""
    names = [c for c in found.columns]
    order = F.struct((-F.col("similarity")).alias("__s"), F.col("chunk_id").alias("__k"), F.struct(*names).alias("__r"))
    rows = F.array_sort(F.collect_list(order))
    kind = found.select(order.alias("o")).schema["o"].dataType.simpleString()

    def step(a: Column, o: Column) -> Column:
        page, doc = o["__r"]["page_id"].cast("string"), o["__r"]["doc_id"].cast("string")
        seen = F.coalesce(F.array_contains(a.pages, page), F.lit(False)) | F.coalesce(F.array_contains(a.docs, doc), F.lit(False))
        kept = F.struct(F.when(page.isNull(), a.pages).otherwise(F.array_append(a.pages, page)).alias("pages"), F.when(doc.isNull(), a.docs).otherwise(F.array_append(a.docs, doc)).alias("docs"), F.array_append(a.out, o).alias("out"))
        return F.when(seen | (F.size(a.out) >= limit), a).otherwise(kept)

    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("pages"), none.alias("docs"), F.array().cast(f"array<{kind}>").alias("out"))
    return found.agg(rows.alias("__rows")).select(F.inline(F.aggregate("__rows", zero, step, lambda a: a.out))).select("__r.*")


def fetch_page(pages: DataFrame, doc_id: str) -> DataFrame:
    """The page of a doc_id (S7), deleted ones included; no row unless there is exactly one."""
    return pages.filter(F.col("doc_id") == doc_id).limit(2).groupBy("doc_id").agg(F.count("*").alias("__n"), F.first(F.struct(*pages.columns)).alias("__r")).filter("__n = 1").select("__r.*")


def first_hits(titles: DataFrame, term: str, order: list[str]) -> DataFrame:
    """The first title of each doc_id that matches ``term``, in the list's order (F2): a page
    with several titles is found by any of them, and has the tier of that one."""
    hit = titles.withColumn("tier", title_tier(F.col("title"), term)).filter("tier is not null")
    rest = [c for c in hit.columns if c != "doc_id"]
    first = hit.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select("doc_id", *(F.col(f"__r.{c}").alias(c) for c in rest))


def hybrid_search(titles: DataFrame, found: DataFrame, pages: DataFrame, term: str, category: str | None = None, limit: int = LIMIT, shown: int = 3, order: tuple[str, ...] = ("doc_id", "title")) -> DataFrame:
    """(role, place, doc_id, title, match_type, similarity) of a search.

    ``titles`` is the list of page titles (doc_id, title, category) in the order of the
    columns ``order``, ``found`` the result of search_rules for twice the limit.  Title hits come first; pages found by meaning
    that are no title hits follow.  The page selected is the first title hit, as its page
    has it, else the first by meaning."""
    listed = titles if category is None else titles.filter(F.col("category") == category)
    hits = first_hits(listed, term, list(order)).orderBy("tier", *order).limit(shown)
    place = F.row_number().over(W.orderBy("tier", *order))
    kind = F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("contains")), F.col("tier"))
    exact = hits.select(F.lit("exact").alias("role"), place.cast("long").alias("place"), "doc_id", "title", kind.alias("match_type"), F.lit(None).cast("double").alias("similarity"))
    meant = distinct_pages(found, limit).join(hits.select("doc_id"), "doc_id", "left_anti")
    order = F.row_number().over(W.orderBy(F.desc("similarity"), "chunk_id"))
    semantic = meant.select(F.lit("semantic").alias("role"), order.cast("long").alias("place"), "doc_id", "title", F.lit("semantic").alias("match_type"), "similarity")
    both = exact.unionByName(semantic)
    first = both.orderBy("role", "place").limit(1)
    full = pages.groupBy("doc_id").agg(F.count("*").alias("__n"), F.min("title").alias("__title"))
    chosen = first.join(full, "doc_id", "left").select(
        F.lit("selected").alias("role"), F.lit(0).cast("long").alias("place"), "doc_id",
        F.when((F.col("role") == "exact") & (F.col("__n") == 1), F.col("__title")).otherwise(F.col("title")).alias("title"),
        F.when((F.col("role") == "exact") & (F.col("__n") == 1), "exact").otherwise(F.col("match_type")).alias("match_type"), "similarity",
    )
    return both.unionByName(chosen)
