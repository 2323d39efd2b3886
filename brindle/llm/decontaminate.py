"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of k = floor(RATE * m) edits is
split into k + 1 pieces.  Wherever the item occurs in a text with at most k
edits, one piece occurs unchanged, so all pieces of all items are searched for at
once and each hit's surroundings are verified with Myers' bit-parallel distance.

Both sides are compared in lower case with every run of characters other than
letters and digits as one space.  Items too short for any edit (k = 0) must occur
as whole words.  Items without letters or digits match nothing.

Items are a stated query set: they are sent to the tasks in blocks of at most
BLOCK_CHARS characters, each block against all rows.  A worker holds one block at a
time: rows found come from one scan of the documents for each block; where rows pass
through, what one block leaves is written and reread before the next.

Edge cases: null and empty texts and items match nothing; texts of any length are
searched whole; an item that occurs repeatedly in a text is reported once with
its least distance; equal items are reported each; an item without id is searched
like any other, reported with a null id and before the others; repeated rows give repeated
results; empty tables give empty results; other columns of the documents pass
untouched (one named as the new column is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.arrow import slices, small_batches
from brindle.llm.columns import numbered
from brindle.llm.work import Work

#: Edits allowed for each character of an item; characters of a block of items
#: (some 60 bytes of a worker's memory for each).
RATE, BLOCK_CHARS = 0.08, 2_000_000
_OTHER = re.compile(r"[\W_]+")
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Item:
    """One test item; its bit masks are made when it is first verified."""

    def __init__(self, item_id: int | None, text: str, rate: float):
        self.id, self.text, self.m = item_id, text, len(text)
        self.budget = int(rate * len(text))

    @cached_property
    def masks(self) -> dict[str, int]:
        """Of each letter, a bit for every place that holds it."""
        found: dict[str, int] = {}
        for i, ch in enumerate(self.text):
            found[ch] = found.get(ch, 0) | 1 << i
        return found

    def pieces(self) -> list[tuple[str, int]]:
        cuts = [self.m * i // (self.budget + 1) for i in range(self.budget + 2)]
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def best(self, window: str) -> tuple[int, int]:
        """Least distance of the item to any part of the window, and where that part ends."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, least = full, 0, self.m, (self.m, 0)
        masks = self.masks
        for end, ch in enumerate(window, 1):
            eq = masks.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score < least[0]:
                least = (score, end)
        return least

    def first(self, window: str, end: int, distance: int) -> int:
        """Start of the occurrence ending at ``end``: the same search backwards."""
        back = Item(self.id, self.text[::-1], 0)
        return end - back.best(window[max(0, end - self.m - distance) : end][::-1])[1]


class Matcher:
    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float):
        self.items = [Item(i, t, rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for piece, at in item.pieces():
                places.setdefault(piece, []).append((n, at))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()
        self.empty = not places

    def leaks(self, raw: str) -> Iterator[dict]:
        """Every item found in a text, with offsets into the text compared."""
        text = normal(raw)
        if self.empty or not text:
            return
        near: dict[int, set[int]] = {}
        for last, (size, where) in self.search.iter(text):
            for n, at in where:
                near.setdefault(n, set()).add(last + 1 - size - at)
        for n, starts in sorted(near.items(), key=lambda x: (self.items[x[0]].id is not None, self.items[x[0]].id or 0)):
            if found := self._verified(self.items[n], text, sorted(starts)):
                yield {"item_id": self.items[n].id, "distance": found[0], "start": found[1], "end": found[2]}

    def _verified(self, item: Item, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        best, reach = None, None
        for start in starts:
            if start >= 0 and text.startswith(item.text, start):
                end = start + item.m
                if item.budget or (f" {text} ".startswith(" ", start) and f" {text} ".startswith(" ", end + 1)):
                    return 0, start, end
            elif item.budget and (reach is None or start > reach):
                # diagonals close to each other share one window
                low, reach = max(0, start - item.budget), start + item.budget
                window = text[low : reach + item.m + item.budget]
                distance, end = item.best(window)
                if distance <= item.budget:
                    found = (distance, low + item.first(window, end, distance), low + end)
                    best = found if best is None else min(best, found)
        return best


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple[int | None, str], ...], rate: float) -> Matcher:
    """The matcher of the block of items that a worker process is at."""
    return Matcher(items, rate)


def blocks_of(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The normalised items in blocks of at most ``limit`` characters (or one item)."""
    block, held = [], 0
    for row in items.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and held + len(text) > limit:
            yield tuple(block)
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield tuple(block)


def _passed(docs: DataFrame, items: DataFrame, step) -> DataFrame:
    """``docs`` after step(docs, block) for every block of items, written between."""
    work, first = Work(docs.sparkSession), True
    small_batches(docs.sparkSession)
    for block in blocks_of(items):
        docs = step(docs if first else work.saved(docs), docs.sparkSession.sparkContext.broadcast(block))
        first = False
    return docs


def with_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text", into: str = "leaks") -> DataFrame:
    """Adds array<struct<item_id, distance, start, end>>: the items found in ``text``.

    Offsets count characters of the normalised text.  No shuffle.
    """

    def step(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = matcher(sent.value, rate)
            for batch, texts in slices(batches, text):
                place = batch.schema.get_field_index(into)
                before = batch.column(place).to_pylist()
                found = pa.array([[*b, *own.leaks(t)] for b, t in zip(before, texts, strict=True)], batch.schema.field(place).type)
                yield batch.set_column(place, batch.schema.field(place), found)

        return rows.mapInArrow(run, rows.schema)

    told = docs.withColumn(into, F.array().cast(T.ArrayType(LEAK)))
    return _passed(numbered(told, text, into), items, step).toDF(*told.columns)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """The documents in which no item is found, with their columns unchanged."""

    def step(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = matcher(sent.value, rate)
            for batch, texts in slices(batches, text):
                yield batch.filter(pa.array([next(own.leaks(t), None) is None for t in texts], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return _passed(numbered(docs, text), items, step).toDF(*docs.columns)


def found_items(docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, distance, start, end): a row for every item found in a document;
    one scan of the documents for each block of items."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, distance int, start int, end int"
    docs = docs.select(key, text)
    out = docs.sparkSession.createDataFrame([], schema)
    for number, block in enumerate(blocks_of(items)):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = matcher(sent.value, rate)
            for batch, texts in slices(batches, text):
                rows = [(i, leak) for i, t in enumerate(texts) for leak in own.leaks(t)]
                if rows:
                    keys = batch.column(batch.schema.get_field_index(key)).take(pa.array([i for i, _ in rows]))
                    fields = [pa.array([leak[f.name] for _, leak in rows], pa.int64() if f.name == "item_id" else pa.int32()) for f in LEAK.fields]
                    yield pa.RecordBatch.from_arrays([keys, *fields], [key, *LEAK.names])

        part = docs.mapInArrow(run, schema)
        out = out.unionByName(part) if number else part
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of document and benchmark item found in it, with the distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = found_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("distance").cast("long").alias("distance"))
