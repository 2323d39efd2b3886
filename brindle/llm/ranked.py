"""Ranked lexical search with block-max indexes.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
in lower case.  The score of a document is a sum of integers, one for each term of the
item that it holds (``weight`` and ``impact``); equal scores rank by ascending id.

How it goes:

1.  Every task cuts its documents into segments and writes an index of each: for each
    term its documents in blocks of BLOCK postings, compressed, with the first and last
    document and the pairs (tf, least length) from which the block's greatest impact
    follows, whatever the corpus turns out to hold.  Texts never shuffle.
2.  Documents, terms and the documents of each asked term are counted over the index.
3.  Items are searched in blocks of at most ITEM_CHARS characters.  Blocks of postings
    of asked terms meet by segment.  For each item, shallow moves over the blocks' ends
    give stretches of documents in which every list stays in one block, and the sum of
    the blocks' greatest impacts.  Stretches below the threshold, the K-th best score so
    far, are skipped and their blocks stay compressed.  In others the lists of greatest
    impact are opened first, and of the rest only the blocks of documents that can still
    reach the threshold.  A block is opened once a segment.
4.  A task keeps the K best of each item over all its segments, so that what follows the
    segments is K rows an item and task, ranked by a window.

Edge cases: null, empty and termless texts are in no list and count nowhere; an item
without text or terms has no rows; rows of equal id are documents or items of their own;
a null id ranks before others of its score; a term counts once in an item, as often as
it stands in a document; very long texts are read whole; empty tables give an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.arrow import slices, small_batches
from brindle.llm.packing import binaries, gaps, packed, unpacked
from brindle.llm.work import Work

#: Postings of a block and (about) of a segment; results of an item; characters of the
#: items that are searched together and sent to the tasks.
BLOCK, SEGMENT, K, ITEM_CHARS = 128, 1_500_000, 50, 500_000
#: Documents scored together at most.
RUN = 4096
_INDEX = "segment string, term string, first int, last int, n int, total long, impacts binary, docs binary, tfs binary"
_NAMES = [f.split()[0] for f in _INDEX.split(", ")]
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def weight(n: int, df: int) -> int:
    """Of a term that df of n documents hold."""
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What one unit of weight gives in documents of so many terms, of n with ``total`` terms."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * length * n // total))


class _Builder:
    """The postings of one segment."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids, self.lengths, self.parts, self.size = [], [], [], 0

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        found = [terms_of(t) for t in texts]
        keep = [i for i, f in enumerate(found) if f]
        if not keep:
            return
        coded = pa.array([w for i in keep for w in found[i]], pa.binary()).dictionary_encode()
        own = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in coded.dictionary.to_pylist()), dtype=np.int64)
        lengths = [len(found[i]) for i in keep]
        doc = np.repeat(np.arange(len(self.ids), len(self.ids) + len(keep)), lengths)
        both, tf = np.unique(own[coded.indices.to_numpy()] << 32 | doc, return_counts=True)
        self.parts.append((both, tf.astype(np.int32)))
        self.size += len(both)
        self.ids += [ids[i] for i in keep]
        self.lengths += lengths

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """The documents' row, then a row for each block; documents are numbered by ascending id."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        length = np.array(self.lengths)[order]
        ids = np.array([self.ids[i] or 0 for i in order], dtype=np.int64)
        head = [[name], [None], [sum(i is None for i in self.ids)], [0], [len(ids)], [int(length.sum())], [None], [ids.tobytes()], [packed(length)[0].tobytes()]]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(head, types, strict=True)], _NAMES)
        both, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        both = both >> 32 << 32 | number[both & 0xFFFFFFFF]
        order = np.argsort(both)
        both, tf = both[order], tf[order].astype(np.int64)
        term, doc = both >> 32, both & 0xFFFFFFFF
        place = np.arange(len(term)) - np.searchsorted(term, term)
        starts = np.flatnonzero(place % BLOCK == 0)
        cuts = np.append(starts, len(term))
        columns = []
        for values in (gaps(doc, starts), tf):
            data, ends = packed(values)
            columns.append(binaries(data, np.concatenate(([0], ends))[cuts]))
        # the least length for each tf of a block
        block = np.cumsum(place % BLOCK == 0) - 1
        order = np.lexsort((tf, block))
        first = np.flatnonzero((np.diff(block[order], prepend=-1) != 0) | (np.diff(tf[order], prepend=0) != 0))
        pairs = np.stack((tf[order][first], np.minimum.reduceat(length[doc[order]], first)), axis=1).reshape(-1)
        data, ends = packed(pairs)
        edges = np.searchsorted(block[order][first], np.arange(len(starts) + 1))
        impacts = binaries(data, np.concatenate(([0], ends))[2 * edges])
        names = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        whole = [pa.array([name] * len(starts)), names.take(pa.array(term[starts])), *(pa.array(x, pa.int32()) for x in (doc[starts], doc[cuts[1:] - 1], np.diff(cuts))), pa.nulls(len(starts), pa.int64()), impacts, *columns]
        whole = pa.RecordBatch.from_arrays(whole, _NAMES)
        for at in range(0, len(starts), 10_000):
            yield whole.slice(at, 10_000)


def build_index(docs: DataFrame, work: Work) -> DataFrame:
    """The index of all rows, a written table: a row for each segment (term is null) and each
    block of postings."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, segment = TaskContext.get().partitionId(), 0, _Builder()
        for batch, texts in slices(batches):
            segment.add(batch.column("doc_id").to_pylist(), texts)
            if segment.size >= SEGMENT:
                yield from segment.rows(f"{part}.{k}")
                k, segment = k + 1, _Builder()
        yield from segment.rows(f"{part}.{k}")

    return work.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX))


class _List:
    """One term's blocks in a segment; a block is opened when a document of it may matter."""

    def __init__(self, rows: list[tuple], weight: int, segment: _Segment):
        self.first, self.last, sizes = (np.array([r[i] for r in rows]) for i in range(3))
        self.rows, self.weight, self.segment = rows, weight, segment
        self.edges = np.concatenate(([0], np.cumsum(sizes)))
        # a closed block holds its last document only, which keeps the list in order
        self.docs, self.gain = np.repeat(self.last, sizes), np.zeros(int(sizes.sum()), dtype=np.int64)
        self.opened = np.zeros(len(rows), dtype=bool)
        impacts = [unpacked(r[3]).reshape(-1, 2) for r in rows]
        pairs = np.concatenate(impacts)
        best = impact(pairs[:, 0], pairs[:, 1], segment.n, segment.total)
        self.best = weight * np.maximum.reduceat(best, np.cumsum([0, *map(len, impacts[:-1])]))

    def open(self, blocks: np.ndarray) -> None:
        """Unpacks the blocks that are still closed."""
        closed = blocks[~self.opened[blocks]]
        if not len(closed):
            return
        self.opened[closed] = True
        steps, tf = (unpacked(b"".join(self.rows[k][i] for k in closed.tolist())) for i in (4, 5))
        sizes = self.edges[closed + 1] - self.edges[closed]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = np.cumsum(steps)
        docs = sums - np.repeat(sums[starts] - steps[starts], sizes)
        at = np.arange(len(docs)) + np.repeat(self.edges[closed] - starts, sizes)
        self.docs[at] = docs
        self.gain[at] = self.weight * impact(tf, self.segment.length[docs], self.segment.n, self.segment.total)

    def most(self, a: int, b: int) -> int:
        """The greatest gain of documents a to b that the blocks allow."""
        low, high = np.searchsorted(self.last, a), np.searchsorted(self.first, b, side="right")
        return int(self.best[low:high].max()) if low < high else 0

    def add_to(self, score: np.ndarray, a: int) -> None:
        """Adds the gains of all documents from a on to their scores."""
        b = a + len(score)
        self.open(np.arange(np.searchsorted(self.last, a), np.searchsorted(self.first, b)))
        low, high = np.searchsorted(self.docs, (a, b))
        score[self.docs[low:high] - a] += self.gain[low:high]

    def gains(self, docs: np.ndarray) -> np.ndarray:
        """The gain of each of some documents; opens the blocks alone that may hold one."""
        k = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        inside = (self.first[k] <= docs) & (docs <= self.last[k])
        self.open(np.unique(k[inside]))
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(inside & (self.docs[at] == docs), self.gain[at], 0)


class _Segment:
    """The documents of a segment and the lists of the terms asked for in it."""

    def __init__(self, head: tuple, blocks: dict[str, list[tuple]], weights: dict[str, int], n: int, total: int):
        nulls, ids, lengths = head
        self.n, self.total, self.nulls = n, total, nulls
        self.ids, self.length = np.frombuffer(ids, dtype=np.int64), unpacked(lengths)
        self.lists = {t: _List(rows, weights[t], self) for t, rows in blocks.items()}

    def search(self, terms: list[str], best: _Best) -> None:
        """Adds the segment's documents that may be among the best."""
        lists = [self.lists[t] for t in terms if t in self.lists]
        if not lists:
            return
        ends = np.unique(np.concatenate([x.last for x in lists]))
        begins = np.concatenate(([0], ends[:-1] + 1))
        # shallow moves: the block of each list in each stretch, by the blocks' ends alone
        bound = np.zeros(len(ends), dtype=np.int64)
        for x in lists:
            k = np.searchsorted(x.last, begins)
            here = np.minimum(k, len(x.last) - 1)
            bound += np.where((k < len(x.last)) & (x.first[here] <= ends), x.best[here], 0)
        i = 0
        while True:
            alive = i + np.flatnonzero(bound[i:] >= best.least)
            if not len(alive):
                return
            # stretches that may matter, one soon after the other, are scored together
            far = np.flatnonzero((begins[alive[1:]] > ends[alive[:-1]] + BLOCK) | (ends[alive[1:]] >= begins[alive[0]] + RUN))
            j = int(alive[far[0]] if len(far) else alive[-1])
            self.score(lists, int(begins[alive[0]]), int(ends[j]), best)
            i = j + 1

    def score(self, lists: list[_List], a: int, b: int, best: _Best) -> None:
        """Scores documents a to b, the lists of greatest impact first.  As soon as few
        documents can still reach the threshold, they alone are followed."""
        most = sorted(((x.most(a, b), j) for j, x in enumerate(lists)), reverse=True)
        score, rest, some = np.zeros(b - a + 1, dtype=np.int64), sum(m for m, _ in most), None
        for m, j in most:
            if not m:
                break
            rest -= m
            if some is None and best.least > 1:
                can = np.flatnonzero(score + (rest + m) >= best.least)
                if len(can) * 4 < len(score):
                    some, score = can + a, score[can]
            if some is None:
                lists[j].add_to(score, a)
            else:
                score = score + lists[j].gains(some)
                keep = score + rest >= best.least
                some, score = some[keep], score[keep]
                if not len(some):
                    return
        found = np.flatnonzero(score >= best.least)
        if len(found):
            docs = found + a if some is None else some[found]
            best.add(score[found], self.ids[docs], docs < self.nulls)


class _Best:
    """The K best of an item so far; least is the score that a further one needs."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.rows = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool))

    def add(self, *more: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in zip(self.rows, more, strict=True))
        order = np.lexsort((ids, ~null, -score))[: self.k]
        self.rows = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.least = int(score[order[-1]])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their distinct terms, in blocks of bounded size."""
    block, size = [], 0
    for row in items.filter("text is not null").select("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > ITEM_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], [t.decode("utf-8", "surrogatepass") for t in dict.fromkeys(terms_of(row["text"]))]))
        size += len(row["text"])
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    spark = index.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = index.filter("term is null")
    n, total = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    empty = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = [empty]
    for block in _blocks(items):
        # as many rows as a block of items has terms
        asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for _, own in block for t in own})], "term string"))
        lists = index.join(asked, "term", "left_semi")
        weights = {r["term"]: weight(n, r["df"]) for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        run = _searcher([own for _, own in block], weights, n, total, k)
        dealt = lists.unionByName(heads).select("segment", "term", "first", "last", "n", "impacts", "docs", "tfs").repartition(width, "segment").sortWithinPartitions("segment", F.asc_nulls_first("term"), "first")
        found = dealt.mapInArrow(run, "item int, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"))
        out.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _searcher(items: list[list[str]], weights: dict[str, int], n: int, total: int, k: int):
    """A task's search of its segments, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items]

        def done(head: tuple, blocks: dict[str, list[tuple]]) -> None:
            segment = _Segment(head, blocks, weights, n, total)
            for terms, own in zip(items, best, strict=True):
                segment.search(terms, own)

        name, head, blocks = None, None, {}
        for batch in batches:
            for segment, term, first, last, n_docs, impacts, docs, tfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != name:
                    if blocks:
                        done(head, blocks)
                    name, head, blocks = segment, (first, docs, tfs), {}
                else:
                    blocks.setdefault(term, []).append((first, last, n_docs, impacts, docs, tfs))
        if blocks:
            done(head, blocks)
        for i, own in enumerate(best):
            score, ids, null = own.rows
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), pa.array(ids, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item, over an index of all documents."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(\"text\", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace('\\"', '"')
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SPLIT} AS w FROM documents WHERE "text" IS NOT NULL),
 q AS (SELECT row_number() OVER () AS j, item_id, list_distinct({_SPLIT}) AS w FROM benchmark WHERE "text" IS NOT NULL),
 t AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
 p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY k, term),
 f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, t GROUP BY term, n),
 m AS (SELECT k, doc_id, 100 - 50 + ((50 * len(w)::BIGINT * n) // l) AS m FROM d, t WHERE len(w) > 0),
 s AS (SELECT j, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM (SELECT j, item_id, unnest(w) AS term FROM q) JOIN f USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY j, k),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
