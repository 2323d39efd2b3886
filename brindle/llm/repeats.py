"""Substring dedup: passages that a document with a smaller id holds too.

Words are runs other than space and \\t \\n \\v \\f \\r, unchanged.  A window is SIZE
words in a row; a window goes if its words also start in a document of smaller id, and
a word goes with any window that covers it.  Windows are judged on the input.

How it goes:

1.  Documents of the same words are one class; only the least of a class is compared,
    the others go as a whole (their windows are all in the least).
2.  Fixed-block anchors: every document is cut into blocks of BLOCK words that do not
    overlap, half a window, so any window holds a whole one.  Their hashes are the index.
3.  Every rolling window of BLOCK words probes the index.  A hit is a probe that meets
    an anchor, or an anchor that is met by a probe or stands in another class too.
    What shuffles is 4 bytes of hash and a place, packed in rows of a task's slice of
    documents and a bucket of hashes; a hit by chance costs a comparison, no error.
4.  Hits are extended: the windows around a hit, at most half a window to each side, are
    identified by 12 bytes and the bucket's number.  For each the least id is found over
    all documents; consecutive windows that a smaller document holds are the maximal
    repeats.  A passage costs an entry for each document that holds it, however many
    do: pairs of documents are never made.  Of equal windows in a slice one goes to the
    bucket, so a passage that a third of the documents hold is a few bytes a slice.

Edge cases: a null, an empty and a wordless text have no words and lose none, as does a
text of fewer words than a window; a row without id loses nothing and makes others lose
nothing; rows with equal ids are several documents, none smaller than the other; very
long texts are hashed in pieces; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.arrow import lists, slices, small_batches
from brindle.llm.packing import binaries, gaps, packed, unpacked
from brindle.llm.shingles import mix, words_of
from brindle.llm.work import Work

#: Words of a window and of a block: half as many, so that every window holds a block.
SIZE, BLOCK = 50, 25
#: Buckets of hashes for each shuffle partition (hashed buckets spread evenly), and the
#: windows of one bucket, which a task holds at once, that more buckets are made for.
SPREAD, HELD = 4, 1_000_000
#: Windows that a bucket is made for at least: every slice has a row for each bucket.
FEW = 20_000
#: Characters of a slice of documents, about.
SLICE = 2_000_000
#: Ids of wanted texts that are sent to the tasks at most.
SENT = 2_000_000
_RNG = np.random.default_rng(20_25)
_BASES = tuple(int(x) | 1 for x in _RNG.integers(1 << 62, size=2))
_SIDE = "slice string, kind int, bucket int, a binary, b binary, c binary"


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 to base ** (n - 1), in 64 bits."""
    table = known.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        known[base] = table = np.multiply.accumulate(table)
    return table[:n]


def _rolling(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, in time linear in the words."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    base = _BASES[which]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(words ^ np.uint64(which)) * _powers(base, len(words)))))
    return mix((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), n))


def _joined(text: str) -> bytes:
    """The words of a text with one space between."""
    # bytes are split at the six characters alone
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def _identified(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, text, n_words, h1, h2 of every row: equal words, and only they, have equal h1
    and h2.  With ``digest`` the text is the SHA-256 of its words, one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words, counts = words_of(texts)
            edges, sums = np.concatenate(([0], np.cumsum(counts))), []
            for which in (0, 1):
                place = np.arange(len(words)) - np.repeat(edges[:-1], counts)
                longest = int(counts.max(initial=0))
                terms = np.concatenate((mix(words ^ np.uint64(which)) * _powers(_BASES[which], longest)[place], np.zeros(1, dtype=np.uint64)))
                sums.append(np.where(counts > 0, mix(np.add.reduceat(terms, edges[:-1]) ^ counts.astype(np.uint64)), 0))
            told = pa.array([sha256(_joined(t)).hexdigest() for t in texts], pa.string()) if digest else batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), told, pa.array(counts), *(pa.array(s.view(np.int64)) for s in sums)], ["doc_id", "text", "n_words", "h1", "h2"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, text string, n_words long, h1 long, h2 long")


def _buckets(windows: int, held: int, width: int) -> int:
    """Buckets for so many windows, of which ``held`` are kept in memory."""
    return max(min(SPREAD * width, windows // FEW + 1), held // HELD)


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _side(rows: int, slice_: str, kind: int, bucket: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    filled = [*columns, *(pa.nulls(rows, pa.binary()) for _ in range(3 - len(columns)))]
    return pa.RecordBatch.from_arrays([pa.array([slice_] * rows), pa.array([kind] * rows, pa.int32()), pa.array(bucket, pa.int32()), *filled], ["slice", "kind", "bucket", "a", "b", "c"])


#: Kinds of rows, in the order in which a bucket reads them.
DOCS, INDEX, PROBES, ANCHORS = range(4)


def _probes(known: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of every slice: its documents, and for each bucket the anchors (hash and
    class), the other windows and the anchors once more, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (batch, texts) in enumerate(slices(batches, size=SLICE)):
            name = f"{TaskContext.get().partitionId()}.{k}"
            words, counts = words_of(texts)
            edges = np.concatenate(([0], np.cumsum(counts)))
            hashes = _rolling(words, BLOCK, 0)
            doc = np.repeat(np.arange(len(texts)), counts)[: len(hashes)]
            place = np.arange(len(hashes)) - edges[doc]
            good = (place + BLOCK <= counts[doc]) & (counts[doc] >= SIZE)
            h1 = np.asarray(batch.column("h1")).view(np.uint64)
            for kind in (INDEX, PROBES, ANCHORS):
                at = np.flatnonzero(good & ((place % BLOCK == 0) == (kind != PROBES)))
                value = (hashes[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                group = _by_bucket(hashes[at], buckets)
                order = np.lexsort((value, group)) if kind == INDEX else np.argsort(group, kind="stable")
                at, value, group = at[order], value[order], group[order]
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                cuts = np.append(starts, len(at))
                if kind == INDEX:
                    # the least and the greatest class of each hash
                    tag = (h1[doc[at]] >> np.uint64(32)).astype(np.uint32)
                    first = np.flatnonzero((np.diff(value.astype(np.int64), prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                    if not len(first):
                        continue
                    low, high = np.minimum.reduceat(tag, first), np.maximum.reduceat(tag, first)
                    cuts = np.searchsorted(first, cuts)
                    columns = [binaries(x, cuts * 4) for x in (value[first], low, high)]
                else:
                    data, ends = packed(gaps(at, starts))
                    columns = [binaries(value, cuts * 4), binaries(data, np.concatenate(([0], ends))[cuts])]
                yield _side(len(starts), name, kind, group[starts], *columns)
            info = np.stack([np.asarray(batch.column(c).fill_null(0)) for c in ("doc_id", "h1", "h2")])
            yield _side(1, name, DOCS, np.array([crc32(name.encode()) % buckets]), *(pa.array([x.tobytes()], pa.binary()) for x in (edges.astype(np.int64), info)))

    return known.select("doc_id", "text", "h1", "h2").mapInArrow(run, _SIDE)


def _hits(rows: DataFrame) -> DataFrame:
    """The places of hits, in rows of slice and bucket; rows of documents as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index, held = None, None, []
        for batch in batches:
            for name, kind, at, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != bucket:
                    bucket, index, held = at, None, []
                if kind == DOCS:
                    yield _side(1, name, DOCS, np.array([0]), pa.array([a], pa.binary()), pa.array([b], pa.binary()))
                    continue
                if kind == INDEX:
                    held.append(tuple(np.frombuffer(x, dtype=np.uint32) for x in (a, b, c)))
                    if sum(len(h[0]) for h in held) > 2 * HELD:
                        held = [_least(held)]
                    continue
                if index is None:
                    index = _least(held) if held else tuple(np.zeros(0, dtype=np.uint32) for _ in range(3))
                    met, held = index[1] != index[2], []
                values = np.frombuffer(a, dtype=np.uint32)
                where = np.searchsorted(index[0], values)
                found = where < len(index[0])
                found[found] = index[0][where[found]] == values[found]
                if kind == PROBES:
                    met[where[found]] = True
                else:
                    found = met[where]
                if found.any():
                    data, _ = packed(gaps(np.cumsum(unpacked(b))[found], np.array([0])))
                    yield _side(1, name, PROBES, np.array([0]), pa.array([data.tobytes()], pa.binary()))

    return rows.mapInArrow(run, _SIDE)


def _least(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct first values with the least second and the greatest third."""
    value, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.diff(value.astype(np.int64), prepend=-1))
    return value[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _per_slice(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each slice (kind, bucket, a, b, c), in the order of their kinds."""
    name, held = None, []
    for batch in rows:
        for own, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if own != name and held:
                yield held
                held = []
            name = own
            held.append(tuple(row))
    if held:
        yield held


def _places(rows: DataFrame) -> DataFrame:
    """doc_id, h1, h2, places: the words at which hits begin in each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, a, b, _), *hits in _per_slice(batches):
            if not hits:
                continue
            edges, info = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64).reshape(3, -1)
            at = np.sort(np.concatenate([np.cumsum(unpacked(h[2])) for h in hits]))
            doc = np.searchsorted(edges, at, side="right") - 1
            own, counts = np.unique(doc, return_counts=True)
            place = (at - edges[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[own]) for x in info), lists(place, counts.tolist())], ["doc_id", "h1", "h2", "places"])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, places array<int>")


#: Kinds of rows of the second step: documents, entries of a slice, windows and answers.
ENTRIES, WINDOWS, ANSWERS = 1, 2, 3


def _windows(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of every slice: its documents, its windows near hits by bucket (place and
    number of the distinct window), and for each bucket the distinct windows with the least
    and the greatest id that has them in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (batch, texts) in enumerate(slices(batches, size=SLICE)):
            name = f"{TaskContext.get().partitionId()}.{k}"
            ids = np.asarray(batch.column("doc_id"))
            words, counts = words_of(texts)
            edges = np.concatenate(([0], np.cumsum(counts)))
            marks = np.zeros(len(words) + BLOCK + 2, dtype=np.int32)
            places = batch.column("places")
            hits = np.asarray(places.flatten()) + np.repeat(edges[:-1], np.asarray(pa.compute.list_value_length(places)))
            # a window that holds the block at p begins at p + BLOCK - SIZE at the earliest
            np.add.at(marks, np.maximum(hits + BLOCK - SIZE, 0), 1)
            np.add.at(marks, hits + 1, -1)
            near = np.cumsum(marks)[: max(len(words) - SIZE + 1, 0)] > 0
            doc = np.repeat(np.arange(len(texts)), counts)[: len(near)]
            at = np.flatnonzero(near & (np.arange(len(near)) - edges[doc] + SIZE <= counts[doc]))
            if not len(at):
                continue
            w1, w2 = _rolling(words, SIZE, 0)[at], _rolling(words, SIZE, 1)[at].astype(np.uint32)
            group, owner = _by_bucket(w1, buckets), ids[doc[at]]
            order = np.lexsort((owner, w2, w1, group))
            at, w1, w2, group, owner = at[order], w1[order], w2[order], group[order], owner[order]
            fresh = (np.diff(w1, prepend=~w1[:1]) != 0) | (np.diff(w2, prepend=~w2[:1]) != 0)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(at)) - 1
            starts = np.flatnonzero(np.diff(group[first], prepend=-1))
            cuts = np.append(starts, len(first))
            ends = np.stack((owner[first], owner[last]), axis=1).reshape(-1)
            columns = [binaries(w1[first], cuts * 8), binaries(w2[first], cuts * 4), binaries(ends, cuts * 16)]
            yield _side(len(starts), name, WINDOWS, group[first][starts], *columns)
            # in the order of places: consecutive places and their window's number
            back = np.argsort(at)
            number = (np.cumsum(fresh) - 1)[back]
            steps = np.diff(at[back], prepend=0)
            info = np.stack([np.asarray(batch.column(c)) for c in ("doc_id", "h1", "h2")])
            base = np.stack((group[first][starts], starts))
            own = np.array([crc32(name.encode()) % buckets])
            yield _side(1, name, DOCS, own, *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (edges, info, base)))
            yield _side(1, name, ENTRIES, own, pa.array([packed(steps)[0].tobytes()], pa.binary()), pa.array([number.astype(np.uint32).tobytes()], pa.binary()))

    return docs.mapInArrow(run, _SIDE)


def _answers(rows: DataFrame) -> DataFrame:
    """For each slice and bucket the least id of each of its windows, where other slices or
    documents have the window too; other rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            w1, w2 = (np.concatenate([np.frombuffer(h[i], dtype=t) for h in held]) for i, t in ((2, np.uint64), (3, np.uint32)))
            ends = np.concatenate([np.frombuffer(h[4], dtype=np.int64) for h in held]).reshape(-1, 2)
            sizes = np.array([len(h[3]) // 4 for h in held])
            order = np.lexsort((ends[:, 0], w2, w1))
            x, y = w1[order], w2[order]
            first = np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(y, prepend=~y[:1]) != 0))
            run_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
            least = np.empty(len(x), dtype=np.int64)
            least[order] = ends[order, 0][first][run_of]
            asks = least < ends[:, 1]
            edges = np.concatenate(([0], np.cumsum(sizes)))
            for h, a, b in zip(held, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = np.flatnonzero(asks[a:b])
                if len(at):
                    yield _side(1, h[0], ANSWERS, np.array([h[1]]), pa.array([packed(np.diff(at, prepend=0))[0].tobytes()], pa.binary()), pa.array([least[a:b][at].tobytes()], pa.binary()))

        held: list[tuple] = []
        for batch in batches:
            for name, kind, at, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0][1] != at:
                    yield from done(held)
                    held = []
                if kind == WINDOWS:
                    held.append((name, at, a, b, c))
                else:
                    yield _side(1, name, kind, np.array([at]), *(pa.array([x], pa.binary()) for x in (a, b, c)))
        if held:
            yield from done(held)

    return rows.mapInArrow(run, _SIDE)


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, h1, h2, ranges: first and one past the last word of each repeat, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, a, b, c), (_, _, steps, numbers, _), *answers in _per_slice(batches):
            if not answers:
                continue
            edges, info = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64).reshape(3, -1)
            base = dict(np.frombuffer(c, dtype=np.int64).reshape(2, -1).T.tolist())
            at, number = np.cumsum(unpacked(steps)), np.frombuffer(numbers, dtype=np.uint32)
            least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
            for _, bucket, which, low, _ in answers:
                least[base[bucket] + np.cumsum(unpacked(which))] = np.frombuffer(low, dtype=np.int64)
            doc = np.searchsorted(edges, at, side="right") - 1
            gone = least[number] < info[0][doc]
            at, doc = at[gone], doc[gone]
            # windows of one document that touch are one range
            start = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(at, prepend=0) > SIZE))
            if not len(start):
                continue
            stop = np.append(start[1:], len(at)) - 1
            owner = doc[start]
            both = np.stack((at[start], at[stop] + SIZE), axis=1) - edges[owner][:, None]
            own, counts = np.unique(owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[own]) for x in info), lists(both.reshape(-1).astype(np.int32), (2 * counts).tolist())], ["doc_id", "h1", "h2", "ranges"])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, ranges array<int>")


def repeats(docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, ranges) of the documents that lose some words, and (doc_id, h1, h2,
    n_words) of the copies, which lose all: a row for each id and sequence of words."""
    spark = docs.sparkSession
    small_batches(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = _identified(docs).filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= SIZE))
    seen = work.saved(known.select("doc_id", "h1", "h2", "n_words"))
    total = seen.agg(F.sum("n_words")).first()[0] or 0
    least = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    copies = seen.join(least, ["h1", "h2", "doc_id"], "left_anti").select("doc_id", "h1", "h2", "n_words")

    grouped = lambda rows, n, *order: rows.repartition(n, order[0]).sortWithinPartitions(*order)
    buckets = _buckets(total, total // BLOCK, width)
    hits = _hits(grouped(_probes(known, buckets), max(width, buckets // SPREAD), "bucket", "kind"))
    places = work.saved(_places(grouped(hits, width, "slice", "kind")).join(least, ["h1", "h2", "doc_id"]).dropDuplicates(["h1", "h2", "doc_id"]))
    asked = places.agg(F.sum(F.size("places"))).first()[0] or 0
    # in one order, so that a task run again makes the same slices
    near = _texts(known, places, "places").sortWithinPartitions("doc_id", "h1", "h2")
    buckets = _buckets(asked * SIZE // 2, asked * SIZE // 2, width)
    answers = _answers(grouped(_windows(near, buckets), max(width, buckets // SPREAD), "bucket", "kind"))
    return work.saved(_removed(grouped(answers, width, "slice", "kind")).dropDuplicates(["doc_id", "h1", "h2"])), copies.dropDuplicates(["doc_id", "h1", "h2"])


def _texts(known: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The texts of the documents wanted, with more of their columns.

    Up to SENT ids are sent to the tasks, and only texts with one of them shuffle; of more
    ids all texts do."""
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= SENT:
        known = known.join(F.broadcast(ids), "doc_id", "left_semi")
    return known.join(wanted.hint("merge"), ["doc_id", "h1", "h2"]).select("doc_id", "h1", "h2", "text", *columns)


def affected(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, h1, h2, n_removed, kept (what stays, one space between the words): a row for
    each distinct id and sequence of words that loses any."""
    cut, copies = repeats(docs, work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            removed, kept = [], []
            for text, ranges in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                words, left, at = text.encode("utf-8", "surrogatepass").split(), [], 0
                for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                    left += words[at:a]
                    at = b
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "h1", "h2", "n_removed", "kept"])

    texts = _texts(_identified(docs), cut, "ranges").mapInArrow(run, "doc_id long, h1 long, h2 long, n_removed long, kept string")
    # rows of one id and equal words differ in their spaces alone
    return texts.dropDuplicates(["doc_id", "h1", "h2"]).union(copies.select("doc_id", "h1", "h2", F.col("n_words").alias("n_removed"), F.lit("")))


def dedup(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between), for every row."""
    gone = affected(docs, work or Work(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            kept = [k if k is not None else _joined(t).decode("utf-8", "surrogatepass") for t, k in zip(texts, batch.column("kept").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_removed")), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    met = _identified(docs).join(gone, ["doc_id", "h1", "h2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "text", "kept")
    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and of those how many repeat a document of smaller id.

    Only the texts that lose words are looked at again; of others the digest is enough."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = affected(docs, Work(spark)).select("doc_id", "h1", "h2", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("left"))
    met = _identified(docs, digest=True).join(gone, ["doc_id", "h1", "h2"], "left")
    return met.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("left", "text").alias("kept_sha256"))


OP12_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all("text", '[^\x20\x09-\x0D]+') AS words FROM documents),
 i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words), 49) - 48)) AS s FROM w),
 k AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h FROM i),
 m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
 g AS (SELECT doc_id, list(s ORDER BY s) AS starts FROM k JOIN m USING (h) WHERE low < doc_id GROUP BY doc_id),
 c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM g))),
 e AS (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
 r AS (SELECT e.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""
