"""An index for nearest vectors: coarse lists with residual product codes.

Vectors are compared by their directions.  A coarse quantiser deals them out to lists, a
product quantiser codes what is left of each vector beside its list's centre, PARTS bytes
a vector.  Both are fitted by k-means to at most SAMPLE vectors, the least by a hash of
their key; every vector of the table is in the index.  A search scans the codes of the
lists nearest to each query, and compares the best candidates exactly.

Vectors that are null or zero, or of which a number is missing, are in no list, as they are
similar to nothing; an index over none finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.vector import dot, norm
from brindle.operators import search

#: Vectors that the quantisers are fitted to at most; bytes of a code; rounds of k-means.
SAMPLE, PARTS, ROUNDS = 20_000, 16, 12
#: Vectors of a list, about; candidates compared exactly for each result wanted.
LIST, CANDIDATES = 256, 20
#: Share of the nearest neighbours in the sample that the lists searched must hold.
TARGET = 0.97


@dataclass
class Quantiser:
    """Centres of the lists, centres of each part of the residuals, and how many lists a
    search looks at."""

    centres: np.ndarray
    parts: np.ndarray
    probes: int

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centres)

    def codes_of(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = (vectors - self.centres[lists]).reshape(len(vectors), len(self.parts), -1)
        return np.stack([_nearest(left[:, p], centres) for p, centres in enumerate(self.parts)], axis=1).astype(np.uint8)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k groups of vectors, or of as many as there are vectors."""
    centres = vectors[rng.choice(len(vectors), size=min(k, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        # a group that lost all its vectors begins again at one of them
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), vectors[rng.integers(len(vectors), size=len(centres))])
    return centres


def _directions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of a list column, and their rows."""
    rows = column.to_pylist()
    good = [i for i, r in enumerate(rows) if r is not None and all(x is not None for x in r)]
    if not good:
        return np.zeros((0, 1)), np.zeros(0, dtype=np.int64)
    v = np.asarray([rows[i] for i in good], dtype=np.float64)
    size = np.linalg.norm(v, axis=1)
    keep = np.isfinite(size) & (size > 0)
    return v[keep] / size[keep, None], np.asarray(good, dtype=np.int64)[keep]


def fit(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Quantiser | None:
    """The quantisers of a table; None where it has no vector.

    How many lists a search looks at follows from the sample: as many as hold TARGET of
    the ten nearest neighbours of some of its vectors."""
    n = rows.filter(F.col(vector).isNotNull()).count()
    some = rows.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()
    v, _ = _directions(some.column(0).combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64())))
    if not len(v):
        return None
    rng = np.random.default_rng(seed)
    centres = _means(v, max(1, min(round(max(n / LIST, n**0.5)), len(v) // 8, 4096)), rng)
    lists = _nearest(v, centres)
    left, width = v - centres[lists], v.shape[1]
    n_parts = max(p for p in range(1, min(PARTS, width) + 1) if width % p == 0)
    left = left.reshape(len(v), n_parts, -1)
    parts = np.stack([_means(left[:, p], min(256, len(v)), rng) for p in range(n_parts)])
    asked = v[: min(500, len(v))]
    near = np.argsort(-(asked @ v.T), axis=1)[:, 1:11]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(order, lists[near], axis=1).reshape(-1))
    probes = int(depth[min(int(TARGET * len(depth)), len(depth) - 1)]) + 1 if len(depth) else 1
    return Quantiser(centres, parts, probes)


def build(rows: DataFrame, quantiser: Quantiser | None, folder: str, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Writes (key, code, list) of every vector to ``folder``, a folder for each list, and
    reads it back: a search opens the folders of its lists alone."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, code binary, list int"
    if quantiser is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            v, at = _directions(batch.column(1))
            if len(at):
                lists = own.lists_of(v)
                codes = own.codes_of(v, lists)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists, pa.int32())], [key, "code", "list"])

    rows.select(key, vector).mapInArrow(run, schema).write.partitionBy("list").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def nearest(index: DataFrame, quantiser: Quantiser | None, rows: DataFrame, queries: DataFrame, limit: int, *, exact: bool = False, probes: int | None = None, candidates: int = CANDIDATES, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", block: int = search.BLOCK) -> DataFrame:
    """(query_key, key, similarity, rank): the ``limit`` rows nearest to every query, but the
    query itself, as search.match_many has them; with ``exact`` they are its.

    Each block of queries is one scan of the lists that it looks at.  A task keeps the
    ``limit * candidates`` best codes of each query, so what shuffles does not grow with
    the lists, and a list of any size is read by as many tasks as it has files."""
    if exact:
        return search.match_many(queries, rows, limit, query_key=query_key, vector=vector, key=key)
    spark = rows.sparkSession
    ask_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (rows, key)))
    out, held, most = None, [], limit * candidates
    schema = f"`{query_key}` {ask_kind}, `{key}` {kind}, guess double"

    def part(some: list) -> DataFrame:
        ids = [r[query_key] for r in some]
        v, at = _directions(pa.array([r[vector] for r in some], pa.list_(pa.float64())))
        if not len(v):
            return spark.createDataFrame([], schema)
        ids = [ids[i] for i in at]
        order = np.argsort(-(v @ quantiser.centres.T), axis=1)[:, : probes or quantiser.probes]
        sent = spark.sparkContext.broadcast((ids, v, order, quantiser))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, asked, own = sent.value
            tables = np.einsum("qpd,pkd->qpk", q.reshape(len(q), len(own.parts), -1), own.parts)
            best: dict[int, tuple[np.ndarray, list]] = {}
            for batch in batches:
                lists = np.asarray(batch.column(2))
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(lists), -1)
                keys = batch.column(0).to_pylist()
                for one in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == one)
                    for i in np.flatnonzero((asked == one).any(axis=1)).tolist():
                        guess = q[i] @ own.centres[one] + tables[i][np.arange(codes.shape[1]), codes[at]].sum(axis=1)
                        top = np.argpartition(-guess, most)[:most] if len(guess) > most else np.arange(len(guess))
                        score, named = best.get(i, (np.zeros(0), []))
                        score, named = np.concatenate((score, guess[top])), named + [keys[at[j]] for j in top]
                        if len(score) > 4 * most:
                            top = np.argpartition(-score, most)[:most]
                            score, named = score[top], [named[j] for j in top]
                        best[i] = score, named
            for i, (score, named) in best.items():
                top = np.argpartition(-score, most)[:most] if len(score) > most else np.arange(len(score))
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(top)).cast(types[0]), pa.array([named[j] for j in top]).cast(types[1]), pa.array(score[top])], [query_key, key, "guess"])

        wanted = index.filter(F.col("list").isin(*np.unique(order).tolist()))
        types = [f.type for f in wanted.select(F.lit(None).cast(ask_kind).alias("q"), key).limit(0).toArrow().schema]
        return wanted.select(key, "code", "list").mapInArrow(run, schema)

    if quantiser is not None:
        for row in queries.filter(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator():
            held.append(row)
            if len(held) == block:
                out, held = part(held) if out is None else out.union(part(held)), []
        if held:
            out = part(held) if out is None else out.union(part(held))
    out = out if out is not None else spark.createDataFrame([], schema)
    place = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("guess"), key))
    some = out.withColumn("place", place).filter(F.col("place") <= most).select(query_key, key)
    asked = queries.select(query_key, F.col(vector).alias("__q"))
    met = some.join(asked, query_key).join(rows.select(key, vector), key).filter(~F.col(query_key).eqNullSafe(F.col(key)))
    found = met.withColumn("similarity", F.try_divide(dot(F.col(vector), F.col("__q")), norm(F.col(vector)) * norm(F.col("__q"))))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return found.select(query_key, key, "similarity").withColumn("rank", rank).filter(F.col("rank") <= limit)


def recall(found: DataFrame, exact: DataFrame, *, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(n_queries, n_exact, n_found, recall): how many of the exact results were found."""
    hit = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    told = hit.agg(F.countDistinct(query_key).alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return told.withColumn("recall", F.try_divide(F.col("n_found"), F.col("n_exact")))
