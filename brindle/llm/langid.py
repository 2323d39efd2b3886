"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is its letters' vectors,
permuted (rolled) by their place and bound (multiplied); a document is the bundle
(sum) of its trigrams; a language is the bundle of its labelled documents.  The
prediction is the language of greatest cosine.

Letters are case-folded; a-z have vectors of their own, other letters share 37 by
code point; whatever is no letter is a word's edge, and trigrams centred on an
edge are not taken.

Bundles are sums, so every task sends one vector for each language and Spark adds
them up; only (languages x DIM) numbers reach the driver.  Texts are read STRETCH
characters at a time and the vectors of PRESENT trigrams are held at once, so a
task's memory depends neither on the length of a text nor on its alphabet.

A text is in no language that was learned if its cosine is far below what a text of
as many letters in that language would have.  A language whose trigrams meet with
chance s gives n letters of it an expected cosine of sqrt(s n / (1 + s n)); random
vectors blur every cosine by 1 / sqrt(DIM), and n trigrams are a sample that strays by
up to 1 / sqrt(n).  One rule for all lengths:
score >= share * expected - 2 / sqrt(DIM) - 1 / sqrt(n).

Edge cases: a null text and one without letters are ``und`` with score 0; ties go
to the language first in order of name; documents without language are not learned
from; with nothing to learn from, every prediction is ``und``; repeated rows count
as often as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.arrow import slices, small_batches
from brindle.llm.columns import numbered

#: Length of the vectors, seed of the letters, rows bundled at a time.
DIM, SEED, BUNDLE = 1024, 7, 256
#: Characters read, and trigrams whose vectors are held, at a time.
STRETCH, PRESENT = 1_000_000, 4096
#: Share of the expected cosine from which on a text is in a language.
SHARE = 0.3
LETTERS = 64
UND = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Letter number of every code point; 0: no letter."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


@lru_cache(maxsize=1)
def _letter_vectors() -> tuple[np.ndarray, ...]:
    """The letters' vectors, rolled by 2, 1 and 0 places."""
    base = (np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIM)) * 2 - 1).astype(np.int8)
    return tuple(np.roll(base, k, axis=1) for k in (2, 1, 0))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram codes and, ascending, the numbers of their texts, a stretch at a time."""
    joined = " ".join(["", *texts, ""])
    starts = 1 + np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))[:-1] + 1))).astype(np.int64)
    for at in range(0, len(joined) - 2, STRETCH):
        x = _letter_table()[np.frombuffer(joined[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        centre = np.flatnonzero(x[1:-1]) + 1
        owner = np.repeat(np.arange(-1, len(texts)), np.diff(np.searchsorted(centre, starts - at), prepend=0, append=len(centre)))
        if len(centre):
            yield (x[centre - 1] * LETTERS + x[centre]) * LETTERS + x[centre + 1], owner


def _vectors(codes: np.ndarray) -> np.ndarray:
    a, b, c = _letter_vectors()
    return (a[codes // LETTERS**2] * b[codes // LETTERS % LETTERS] * c[codes % LETTERS]).astype(np.float32)


def bundles(texts: list[str], rows: np.ndarray | None = None, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors and numbers of letters of ``n`` rows; rows[i] is the row that
    text i is added to (by default each text has its own).

    Sums stay below 2**24 within a stretch, so they are exact."""
    rows, n = (np.arange(len(texts)), len(texts)) if rows is None else (rows, n)
    out, letters = np.zeros((n, DIM)), np.zeros(n, dtype=np.int64)
    for codes, owner in _grams(texts):
        row = rows[owner]
        letters += np.bincount(row, minlength=n)
        if (np.diff(row) < 0).any():
            order = np.argsort(row, kind="stable")
            codes, row = codes[order], row[order]
        present = np.flatnonzero(np.bincount(codes, minlength=LETTERS**3))
        place = np.zeros(LETTERS**3, dtype=np.int64)
        place[present] = np.arange(len(present))
        where = place[codes]
        for p in range(0, len(present), PRESENT):
            some = present[p : p + PRESENT]
            vectors = _vectors(some)
            inside = slice(None) if len(some) == len(present) else np.flatnonzero((where >= p) & (where < p + PRESENT))
            w, r = where[inside] - p, row[inside]
            for k in range(int(r[0]), int(r[-1]) + 1, BUNDLE):
                i, j = np.searchsorted(r, (k, k + BUNDLE))
                height = min(BUNDLE, n - k)
                counts = np.bincount((r[i:j] - k) * len(some) + w[i:j], minlength=height * len(some)).reshape(height, len(some))
                out[k : k + height] += counts.astype(np.float32) @ vectors
    return out, letters


@dataclass
class Profiles:
    """Languages in order of name, their bundles (rows) and numbers of letters."""

    langs: list[str]
    vectors: np.ndarray
    letters: np.ndarray

    def unit(self) -> np.ndarray:
        return self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)

    def chance(self) -> np.ndarray:
        """Chance that two trigrams of a language are the same."""
        return (self.vectors**2).sum(axis=1) / DIM / np.maximum(self.letters, 1) ** 2


def learn(labelled: DataFrame) -> Profiles:
    """Profiles of the languages in columns text and lang."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches):
            names, rows = np.unique(np.asarray(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object), return_inverse=True)
            vectors, letters = bundles(texts, rows, len(names))
            for name, v, n in zip(names.tolist(), vectors, letters, strict=True):
                found[name] = found.get(name, 0) + np.append(v, n)
        for lang, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    parts = labelled.select("text", "lang").filter("lang is not null and text is not null").mapInArrow(run, "lang string, dim int, value double")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in sums})
    table = np.zeros((len(langs), DIM + 1))
    for r in sums:
        table[langs.index(r["lang"]), r["dim"]] = r["value"]
    return Profiles(langs, table[:, :DIM], table[:, DIM])


def _judge(texts: list[str], known: Profiles, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and number of letters of each text, and whether the score
    is what the language's texts have."""
    vectors, letters = bundles(texts)
    langs = known.langs
    length = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    cosines = np.clip(vectors @ known.unit().T / length[:, None], 0, 1) if langs else np.zeros((len(texts), 1))
    best = np.where((letters > 0) & bool(langs), cosines.argmax(axis=1), len(langs))
    score = np.where(letters > 0, cosines.max(axis=1), 0)
    met = letters * np.append(known.chance(), 0)[best]
    blur = 2 / DIM**0.5 + 1 / np.sqrt(np.maximum(letters, 1))
    native = (letters > 0) & (score >= share * np.sqrt(met / (1 + met)) - blur)
    return np.asarray([*langs, UND], dtype=object)[best], score, letters, native


def predict(docs: DataFrame, known: Profiles, key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(key, lang_pred, score, n_letters, native) for every row of ``docs``; score is
    the cosine with the language predicted, at least 0; native whether it is as high
    as that language's texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, score, letters, native = _judge(texts, known, share)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(names, pa.string()), pa.array(score), pa.array(letters), pa.array(native)], [key, "lang_pred", "score", "n_letters", "native"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, n_letters long, native boolean")


def label(docs: DataFrame, known: Profiles, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` whose text is native in a language learned; ``lang``
    becomes the language predicted.  Where no language was learned, all rows with
    letters stay as they are.

    Rows pass through in one go, all other columns untouched, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, _, _, native = _judge(texts, known, share)
            if known.langs:
                place = batch.schema.get_field_index("lang")
                batch = batch.set_column(place, batch.schema.field(place), pa.array(names, pa.string()))
            yield batch.filter(pa.array(native))

    small_batches(docs.sparkSession)
    rows = numbered(docs, "text", "lang")
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out() -> Column:
    """True for the fifth of the documents that is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = learn(docs.filter(~F.coalesce(held_out(), F.lit(True))))
    return predict(docs, known).select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score", "n_letters", "native")
