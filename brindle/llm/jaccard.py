"""N-gram Jaccard join: documents whose shingle sets overlap enough, as components.

Sets are word shingles.  Two documents link when DEN * |A and B| >= NUM * |A or B|.
The result is exact: a link is only ever left out where its ends are already known
to be in one component.

How it goes:

1.  Equal sets become one class; copies are never compared.
2.  Shingles are put in one global order, rare first.  Rarity comes from counts of
    all shingles in a table of BUCKETS hash buckets, so the size of what is sent to
    the tasks is fixed; whatever the counts, the result is the same.
3.  The prefix index: two sets can only link if they share one of their first
    n - ceil(t n) + 1 shingles.  Index lists of one entry go.
4.  Answers of leaders: the leader of a list is its member with the fewest shingles
    that are in no other prefix, as the original of a group of copies has.  Every
    set is compared with the leaders of most of its lists, and the overlap is kept.
    Sets linked with one are done with each other: a group of near copies costs a
    comparison or two a member.
5.  Answers derived from a leader's: a set that is close to its leader is the leader
    and a few differences, so two such sets differ in what is in one of their
    differences alone.  If one of them is not linked with the leader, they can only
    link if they share differences; those that do are found by a prefix index of
    the differences, and their overlap follows from the differences alone.
6.  The rest of a list, the entries outside its leader's component, is compared
    with its other entries.  Lists are blocked by size class; entries whose
    positions, or whose shingles that are in no other prefix, leave too few to
    share are skipped; pairs must share enough prefix shingles.  Where both ends
    were compared with the same leader, their overlap is bounded by those answers:
    the pair is taken or left without looking at the sets, or else verified on the
    whole sets.

Every document is read four times and never shuffled; what shuffles are prefixes
(about a sixth of the shingles) and the whole sets of candidates alone.

Edge cases: a null text, an empty one and one without words are empty sets that
link with nothing; a text of fewer words than a shingle is one shingle; every row
is a document, so rows with equal ids are several; a null id never is a smallest
id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.arrow import lists, slices, small_batches
from brindle.llm.columns import numbered
from brindle.llm.components import components
from brindle.llm.shingles import mix, shingle_sets
from brindle.llm.work import Work

#: log2 of the hash buckets that count shingles, and of those sent in one row.
BUCKETS, CHUNK = 22, 16
#: log2 of the least and of the greatest number of bits of the filter that says which
#: documents' sets are wanted; it has some sixty for each.
WANTED = (16, 27)
#: Leaders that a set is compared with at most, and the length of a list from which
#: on its members are compared however few lists they share with the leader.
ASKED, LONG = 2, 16
#: Most differences from a leader at which answers are derived from it; sets further
#: away go the way of the rest of the lists.
CLOSE = 256
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def _identity(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit sums over each set: equal sets, and only they, agree in both."""
    return tuple(pa.array(np.fromiter((int(mix(s ^ salt).sum()) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)) for salt in _SALTS)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())


def _read_sets(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, n, h1, h2), and each task's shingle counts
    in rows of 2**CHUNK buckets (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKETS, dtype=np.int64)
        names = ["doc_id", "n", "h1", "h2", "chunk", "counts"]
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, words)
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([_ids(batch), pa.array(map(len, sets), pa.int64()), *_identity(sets), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        packed = np.minimum(counts, 65535).astype("<u2").reshape(-1, 1 << CHUNK)
        for c in np.flatnonzero(packed.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([c], pa.int32()), pa.array([packed[c].tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, chunk int, counts binary")


def _with_identity(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` and the identities of their sets, as __h1 and __h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            h1, h2 = _identity(shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays([*batch.columns, h1, h2], [*batch.schema.names, "__h1", "__h2"])

    return docs.mapInArrow(run, docs.withColumn("__h1", F.lit(0).cast("long")).withColumn("__h2", F.lit(0).cast("long")).schema)


def _rarity(read: DataFrame) -> np.ndarray:
    """Level of every bucket: twice the log2 of its count over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            levels = np.minimum(2 * np.log2(total + 1), 63).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["chunk", "levels"])

        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != at:
                    if at is not None:
                        yield done()
                    at, total = chunk, np.zeros(1 << CHUNK, dtype=np.int64)
                total += np.frombuffer(data, dtype="<u2")
        if at is not None:
            yield done()

    chunks = read.filter("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    levels = np.zeros((1 << (BUCKETS - CHUNK), 1 << CHUNK), dtype=np.uint8)
    for row in chunks.mapInArrow(run, "chunk int, levels binary").collect():
        levels[row["chunk"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels.reshape(-1)


def _prefixes(docs: DataFrame, words: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, h1, h2, n, last, prefix): the rarest shingles of each set, in order;
    last is the place of the prefix's end in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent.value
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, words)
            out, last = [], []
            for s in sets:
                n = len(s)
                place = rare[(s >> np.uint64(64 - BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(57) | s >> np.uint64(7)
                order = np.argsort(place, kind="stable")[: n - -(-num * n // den) + 1] if n else np.zeros(0, dtype=np.int64)
                out.append(s[order].view(np.int64))
                last.append(int(place[order[-1]]) if n else 0)
            columns = [_ids(batch), *_identity(sets), pa.array(map(len, sets), pa.int64()), pa.array(last, pa.int64()), lists(np.concatenate(out), [len(x) for x in out])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "last", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n long, last long, prefix array<bigint>")


def _sets_of(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(h1, h2, shingles) of the documents whose h1 may be among ``wanted``.

    What is sent to the tasks is a filter of 64 bits or more for each one wanted, made in
    tasks as packed rows; the join with the exact classes drops what slips through.  Of more
    than 2**(WANTED[1] - 6) wanted, more and more slip through."""
    spark, count = docs.sparkSession, wanted.count()
    bits = min(max(count.bit_length() + 6, WANTED[0]), WANTED[1])
    place = F.shiftrightunsigned("h1", 64 - bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own = None, np.zeros(1 << CHUNK, dtype=np.uint8)
        for batch in batches:
            rows, places = (np.asarray(c) for c in batch.columns)
            for k in np.unique(rows).tolist():
                if row is not None and k != row:
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["row", "bits"])
                    own[:] = 0
                row = k
                own[places[rows == k]] = 1
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["row", "bits"])

    placed = wanted.select(F.shiftright(place, CHUNK).cast("int").alias("row"), (place % (1 << CHUNK)).cast("int").alias("bit"))
    whole = np.zeros((1 << (bits - CHUNK), (1 << CHUNK) // 8), dtype=np.uint8)
    # at most 2**(WANTED[1] - CHUNK) rows of 2**CHUNK bits
    for r in placed.repartition("row").sortWithinPartitions("row").mapInArrow(pack, "row int, bits binary").collect():
        whole[r["row"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(whole.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, dtype=np.uint8)
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, words)
            h1, h2 = _identity(sets)
            at = (h1.to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            keep = np.flatnonzero(own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).tolist()
            if keep:
                out = [sets[i].view(np.int64) for i in keep]
                yield pa.RecordBatch.from_arrays([_ids(batch).take(pa.array(keep)), h1.take(pa.array(keep)), h2.take(pa.array(keep)), lists(np.concatenate(out), [len(x) for x in out])], ["doc_id", "h1", "h2", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, shingles array<bigint>")


def _needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Least overlap of linked sets of n and m shingles: ceil(num (n + m) / (num + den))."""
    return F.ceil((n + m) * num / F.lit(num + den) - 1e-9).cast("long")


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs, words, num, den
        self.work = Work(docs.sparkSession)
        small_batches(docs.sparkSession)

    def links(self, overlap: Column, n: Column, m: Column) -> Column:
        return self.den * overlap >= self.num * (n + m - overlap)

    def classes(self, read: DataFrame) -> DataFrame:
        """(h1, h2, rep, node, n): one row for each distinct set that is not empty.

        node is rep, the least id of the class; where rows share an id, only the
        first of their classes has it as node, the others their first hash."""
        found = read.filter("chunk is null and n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
        first = found.groupBy("rep").agg(F.min("h1").alias("h"))
        named = found.join(first, found.rep.eqNullSafe(first.rep), "left").select(found["*"], "h")
        return self.work.saved(named.select("h1", "h2", "rep", F.when(F.col("rep").isNotNull() & (F.col("h1") == F.col("h")), F.col("rep")).otherwise(F.col("h1")).alias("node"), "n"))

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b, overlap, delta) of pairs of nodes, on their whole sets.

        delta: what only a has, then what only b has, each in one order; null if
        that is more than CLOSE, or than half as many as a has."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = self.work.saved(classes.join(ends, "node", "left_semi"))
        sets = _sets_of(self.docs, self.words, wanted).dropDuplicates(["doc_id", "h1", "h2"])
        owned = self.work.saved(sets.join(wanted, sets.doc_id.eqNullSafe(wanted.rep) & (sets.h1 == wanted.h1) & (sets.h2 == wanted.h2)).select("node", "shingles"))
        left = owned.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = owned.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(right, "b").join(left, "a").withColumn("overlap", F.size(F.array_intersect("sa", "sb")).cast("long"))
        close = F.size("sa") + F.size("sb") - 2 * F.col("overlap") <= F.least(F.size("sa") / 2, F.lit(CLOSE))
        delta = F.when(close, F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        out = self.work.saved(both.select("a", "b", "overlap", delta.alias("delta")))
        self.work.drop(wanted, owned)
        return out

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """The rows read, and (h1, h2, rep, comp) of every distinct set."""
        work, num, den = self.work, self.num, self.den
        read = work.saved(_read_sets(self.docs, self.words))
        classes = self.classes(read)
        levels = _rarity(read)
        found = _prefixes(self.docs, self.words, num, den, levels).filter("n > 0").dropDuplicates(["doc_id", "h1", "h2"])
        names = classes.select("h1", "h2", "rep", "node")
        index = work.saved(found.join(names, found.doc_id.eqNullSafe(names.rep) & (found.h1 == names.h1) & (found.h2 == names.h2)).select("node", "n", "last", "prefix"))

        entries = index.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = work.saved(entries.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"))
        listed = work.saved(entries.join(shared, "token"))
        # lone: how many of a prefix's shingles no other set has in its own
        held = listed.groupBy("node").agg(F.count("*").alias("held"))
        sizes = index.select("node", "n", "last", F.size("prefix").alias("p")).join(held, "node", "left")
        sizes = sizes.withColumn("lone", F.col("p") - F.coalesce("held", F.lit(0))).drop("held")
        sizes = work.saved(sizes.withColumn("rank", F.col("lone") * 1_000_000 + F.pmod(F.xxhash64("node"), F.lit(1_000_000))))

        work.drop(index, shared)
        work.release()

        # the answers of leaders
        leaders = listed.join(sizes.select("node", "rank"), "node").groupBy("token").agg(F.min_by("node", "rank").alias("leader"), F.count("*").alias("size"))
        votes = listed.join(leaders, "token").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.max("size").alias("size"))
        likely = votes.filter((F.col("k") * 4 * den > (den - num) * F.col("n")) | (F.col("size") >= LONG))
        best = likely.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", (-F.col("leader")).alias("minus"))), asc=False).alias("v"))
        asked = best.select(F.col("node").alias("a"), F.explode(F.slice("v", 1, ASKED)).alias("v")).select("a", (-F.col("v.minus")).alias("b"))
        answers = self.verified(work.saved(asked), classes)
        n_a, n_b = (sizes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
        judged = work.saved(answers.join(n_a, "a").join(n_b, "b"))
        linked = judged.filter(self.links(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")
        groups = work.saved(components(linked, work))
        work.release()

        # what is left of each list
        about = sizes.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        nearest = judged.groupBy("a").agg(F.max(F.struct("overlap", (-F.col("b")).alias("minus"), "nb", "delta")).alias("v"))
        refs = work.saved(nearest.select(F.col("a").alias("node"), (-F.col("v.minus")).alias("ref"), F.col("v.overlap").alias("overlap"), F.col("v.nb").alias("ref_n"), F.col("v.delta").alias("delta")))
        about = about.join(refs.select("node", "ref", "overlap", "ref_n", F.col("delta").isNotNull().alias("close")), "node", "left")
        about = work.saved(about)
        # of all entries only the components are looked up; what is known about a set
        # joins the entries of the lists that hold several components
        joined = listed.select("token", "node", "pos").join(about.select("node", "comp", "rank"), "node")
        mixed = joined.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("rank", "comp"))["comp"].alias("c0")).filter("low <> high").select("token", "c0")
        open_ones = work.saved(listed.select("token", "node", "pos").join(work.saved(mixed), "token"))
        work.drop(listed)
        work.release()
        rest = work.saved(open_ones.join(about, "node"))
        work.drop(open_ones)
        work.release()
        derived = self.derived_links(about, refs.select("node", "delta"))
        pairs = self.left_over(rest)
        sure = pairs.filter("sure").select("a", "b")
        more = self.verified(work.saved(pairs.filter("not sure").select("a", "b")), classes).join(n_a, "a").join(n_b, "b")
        edges = linked.union(derived).union(sure).union(more.filter(self.links(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b"))
        groups = components(edges, work)

        named = classes.join(groups, "node", "left").select("h1", "h2", "rep", F.coalesce("comp", "node").alias("comp"))
        named = work.saved(named)
        work.drop(judged, refs, about, rest)
        return read, named

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        read, named = self.grouped()
        least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        final = self.work.saved(named.join(least, "comp").select("h1", "h2", "component_id"))
        rows = read.filter("chunk is null").select("doc_id", "n", "h1", "h2")
        return rows.join(final, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def first_rows(self) -> DataFrame:
        """One row of ``docs`` for each component, columns unchanged."""
        _, named = self.grouped()
        # the least id, null ids last
        first = named.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.coalesce("rep", F.lit(0)).alias("id"), "h1", "h2")).alias("v"))
        keys = [f"__{k}" for k in ("none", "id", "h1", "h2")]
        kept = self.work.saved(first.select(*(F.col(f"v.{k[2:]}").alias(k) for k in keys)))
        own = self.docs.columns
        rows = _with_identity(self.docs, self.words).withColumn("__none", F.col("doc_id").isNull()).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
        # rows of equal id and equal set are one; the row is picked by its text, as not
        # every type has an order
        one = rows.join(kept, keys).groupBy(*keys).agg(F.min_by(F.struct(*own), "text").alias("__row"))
        return one.select("__row.*")

    def derived_links(self, about: DataFrame, deltas: DataFrame) -> DataFrame:
        """(a, b): links of sets close to the same leader, of different components.

        With dX the differences of X to the leader R, X and Y differ in
        |dX| + |dY| - 2 |dX and dY|, and link if that is at most c (|X| + |Y|), where
        c = (den - num) / (den + num).  One of them, X, is not linked with R, so
        |dX| = c (|X| + |R|) + e with e > 0; as |Y| <= |R| + |dY|, they share at least
        (e + (1 - c) |dY|) / 2 differences, which is at least e / (1 + c).
        """
        num, den = self.num, self.den
        c = (den - num) / (den + num)
        d = F.size("delta")
        close = about.filter("close").join(deltas, "node").withColumn("d", d).withColumn("far", ~self.links(F.col("overlap"), F.col("n"), F.col("ref_n")))
        close = self.work.saved(close.join(close.filter("far").select("ref").distinct(), "ref", "left_semi").select("ref", "node", "comp", "n", "ref_n", "d", "far", "delta"))
        least_x = F.ceil((F.col("d") - c * (F.col("n") + F.col("ref_n"))) / (1 + c) - 1e-9).cast("int")
        least_y = F.ceil((1 - c) * F.col("d") / 2 - 1e-9).cast("int")

        def entries(rows: DataFrame, least: Column, side: str) -> DataFrame:
            head = F.slice("delta", F.lit(1), F.col("d") - F.greatest(least, F.lit(1)) + 1)
            out = rows.filter("d > 0").select("ref", "node", "comp", "n", "d", "far", "delta", F.posexplode(head).alias("pos", "token"))
            return out.select(*(F.col(k).alias(f"{side}_{k}") for k in out.columns))

        x, y = entries(close.filter("far"), least_x, "x"), entries(close, least_y, "y")
        xd, yd, xn, yn = (F.col(k) for k in ("x_d", "y_d", "x_n", "y_n"))
        # twice the least number of shared differences
        twice = xd + yd - (xn + yn) + 2 * _needed(xn, yn, num, den)
        room = F.least("x_pos", "y_pos") + 1 + F.least(xd - F.col("x_pos") - 1, yd - F.col("y_pos") - 1)
        once = ~F.col("y_far") | (F.col("x_node") < F.col("y_node"))
        # a pair is judged where it meets, and given once: at the first difference it shares
        both = F.array_intersect("x_delta", "y_delta")
        judged = (2 * room >= twice) & (2 * F.size(both) >= twice) & (F.get(both, F.lit(0)) == F.col("x_token"))
        met = x.join(y, (F.col("x_ref") == F.col("y_ref")) & (F.col("x_token") == F.col("y_token")) & (F.col("x_comp") != F.col("y_comp")) & once & judged)
        out = self.work.saved(met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))
        self.work.drop(close)
        return out

    def left_over(self, rest: DataFrame) -> DataFrame:
        """(a, b, sure): pairs that may link, of different components; sure ones do.

        Pairs of a set and its leader, and of two sets close to the same leader,
        have had their answer."""
        num, den = self.num, self.den
        # any two linked sets are in the same size class or in neighbouring ones
        size_class = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(den / num)) + 1e-9)
        keyed = rest.withColumn("sc", size_class(F.col("n")))
        x = keyed.filter("comp <> c0").select(*(F.col(c).alias(f"x_{c}") for c in keyed.columns)).withColumn("near", F.explode(F.array(F.col("x_sc") - 1, F.col("x_sc"), F.col("x_sc") + 1)))
        y = keyed.select(*(F.col(c).alias(f"y_{c}") for c in keyed.columns))
        xn, yn = F.col("x_n"), F.col("y_n")
        need = _needed(xn, yn, num, den)
        room = F.least("x_pos", "y_pos") + 1 + F.least(xn - F.col("x_pos") - 1, yn - F.col("y_pos") - 1)
        once = (F.col("y_comp") == F.col("y_c0")) | (F.col("x_node") < F.col("y_node"))
        # the prefix that ends first in the global order: what of it is in the other set
        # is in its prefix too, so its lone shingles are not shared; where both end at
        # one place, the looser bound, as a pair comes either way round
        def first_end(of_x: Column, of_y: Column) -> Column:
            return F.when(F.col("x_last") < F.col("y_last"), of_x).when(F.col("x_last") > F.col("y_last"), of_y).otherwise(F.greatest(of_x, of_y))

        most = first_end(xn - F.col("x_lone"), yn - F.col("y_lone"))
        sized = (den * F.least(xn, yn) >= num * F.greatest(xn, yn)) & (room >= need) & (most >= need)
        known = (F.col("x_ref") == F.col("y_ref")) & F.col("x_close") & F.col("y_close")
        met = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("near") == F.col("y_sc")) & (F.col("x_comp") != F.col("y_comp")) & once & sized & ~F.coalesce(known, F.lit(False)))
        # shingles past the prefix that ends first in the global order can still be shared
        past = first_end(xn - F.col("x_p"), yn - F.col("y_p"))
        xo, yo, same = F.col("x_overlap"), F.col("y_overlap"), F.col("x_ref") == F.col("y_ref")
        through = F.least(xo, yo) + F.least(xn - xo, yn - yo)
        derived = F.when(same & (through < need), -1).when(same & (xo + yo - F.col("x_ref_n") >= need), 1).otherwise(0)
        lone = met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), (need - past).alias("least"), derived.alias("derived"))
        # least and derived are the same in all rows of a pair
        counted = lone.filter("derived >= 0").groupBy("a", "b").agg(F.min("least").alias("least"), F.min("derived").alias("derived"), F.count("*").alias("k"))
        return self.work.saved(counted.filter("k >= least").select("a", "b", (F.col("derived") == 1).alias("sure")))


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    return _Join(docs, words, num, den).run()


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of least id of each component, columns unchanged; null ids come last.

    One row stays of each component, also where ids are repeated or null; rows
    without words, which link with nothing, all stay.  Other columns may have any
    name and type."""
    words_in = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = numbered(docs, "doc_id", "text")
    return _Join(rows.filter(words_in), words, num, den).first_rows().union(rows.filter(~words_in)).toDF(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under 4-word shingles and 85 of 100."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
