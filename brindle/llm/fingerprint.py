"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the K least distinct hashes of a text's shingles (five words), in
ascending order.  The sketch of a union is the K least of both sketches, so
sketches merge across parts; two sketches give estimates of resemblance and
containment, one the number of distinct shingles.  Sets below K are exact.

Edge cases: a null or empty text has an empty sketch and the fingerprint '';
empty against empty resembles 1, empty against others 0; texts of fewer than five
words are one shingle; repeated rows and equal ids are ordered by text; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.arrow import lists, slices
from brindle.llm.shingles import shingle_sets

#: Hashes of a sketch, words of a shingle, bits of a sketched hash.
K, WORDS, BITS = 64, 5, 48
#: Ranges of ids for each shuffle partition, so that hashed ranges spread evenly.
RANGES = 4


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sketch of every text, as int64."""
    shift = np.uint64(64 - BITS)
    return [np.unique(s[: 4 * K] >> shift)[:K].astype(np.int64) if len(s) else s.astype(np.int64) for s in shingle_sets(texts, WORDS)]


def with_sketch(df: DataFrame, text: str = "text", into: str = "sketch") -> DataFrame:
    """Adds array<bigint> ``into``, replacing a column of that name."""

    @F.pandas_udf("array<bigint>")
    def udf(column: pd.Series) -> pd.Series:
        return pd.Series(sketches(column.fillna("").tolist()))

    return df.withColumn(into, udf(F.col(text)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, K)


def resemblance(a: Column, b: Column) -> Column:
    """Estimate of |A and B| / |A or B|: the share of the union's sketch in both."""
    both = F.size(F.array_intersect(merge(a, b), F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(F.size(merge(a, b)), F.lit(1)))


def distinct_count(a: Column) -> Column:
    """Estimate of the number of distinct shingles; exact below K."""
    spread = F.element_at(a, K).cast("double") + 1
    return F.when(F.size(a) < K, F.size(a).cast("double")).otherwise(F.lit((K - 1) * 2.0**BITS) / spread)


def containment(a: Column, b: Column) -> Column:
    """Estimate of |A and B| / |A|; 1 for an empty A."""
    shared = resemblance(a, b) * distinct_count(merge(a, b))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def _with_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """The rows with the number of their id range, and once more the first row of each
    range as the last of the range before it (``tail``; before the first comes the
    last range that has rows).

    Ranges hold about equally many rows, null ids are in the first.  Only their cuts
    and first ids reach the driver: two numbers for each range."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else None
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else None
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))) if cuts else F.lit(0)
    low = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    firsts = sorted((r["range"], r["id"]) for r in docs.select("doc_id").groupBy(number.alias("range")).agg(low.alias("id")).collect())
    # as many rows as there are ranges
    before = F.broadcast(docs.sparkSession.createDataFrame([(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)], "range int, first long"))
    heads = docs.join(before, docs["doc_id"].eqNullSafe(before["first"])).groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    return docs.select("doc_id", "text", number.alias("range"), F.lit(False).alias("tail")).union(heads.select("doc_id", "text", "range", F.lit(True)))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch of every
    row, next to its neighbour in ascending doc_id (the first follows the last).

    One shuffle of the texts by ranges of ids; every task reads its ranges in
    order, each followed by the first row of the next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch, texts in slices(batches):
            ids, tails = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "tail"))
            own = sketches(texts)
            if held:
                ids, texts, tails, own = [held[0], *ids], [held[1], *texts], [held[2], *tails], [held[3], *own]
            held = (ids[-1], texts[-1], tails[-1], own[-1])
            # a range ends with a tail, which is the next of the row before it
            rows = [i for i in range(len(ids) - 1) if not tails[i]]
            if rows:
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in rows]
                columns = [pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited])]
                for s in ([own[i] for i in rows], sketches(edited), [own[i + 1] for i in rows]):
                    columns.append(lists(np.concatenate(s), [len(x) for x in s]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch"])

    ordered = _with_ranges(docs, RANGES * width).repartition(width, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, sketch array<bigint>, edited_sketch array<bigint>, next_sketch array<bigint>")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    found = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct_count(F.col("sketch")), 3).alias("n_shingles_estimate"),
    )
