"""Filter interaction audit: what each of five filters removes, in every order.

A filter fails a document on one condition; the five conditions of a document are the
bits of a number below 32.  How many documents of a part have each number is all that
any order of filters needs.

How it goes:

1.  The word pipeline: texts are dealt by document, words exploded and aggregated by
    (document, word), then by document, for totals and distinct words.  Both
    aggregations keep the partitioning, so the texts shuffle once and words never do.
    The first piece of each text counts the rows of a document.
2.  The other flags come from a scan of their own: characters, the least id of each
    text (grouped by 128 bits of hash, combined before the shuffle), labels.
3.  All meet by outer joins on the document; 32 conditional counts for all documents,
    the good and the toxic ones are aggregated for each part.
4.  The 120 orders of five filters are made of numbers in base five, and every step's
    counts are sums over the 32.

Edge cases: a null text is an empty one (no words: A fails, B does not); a row without
id is no copy, nor is any row a copy of it; rows of equal id are several documents, none
a copy of the other; labels without id label nothing, of several labels of a document
one that says 1 is enough, null is 0; an empty table has no part and gives no rows; very
long texts are split whole; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The filters, in the order of their bits; least words, least share of distinct words
#: and greatest share of capitals, in percent; characters that no text may hold.
FILTERS, WORDS, DISTINCT, CAPITALS, MARKS = "ABCDE", 100, 80, 10, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
_KINDS = ("n", "good", "toxic")


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of it, which stand for the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, words, distinct_words of every document."""
    dealt = docs.select("doc_id", "h1", "h2", "text").repartition("doc_id", "h1", "h2")
    # a text has a first piece, an empty one if nothing else
    words = dealt.select("doc_id", "h1", "h2", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+")).alias("pos", "word"))
    by_word = words.groupBy("doc_id", "h1", "h2", "word").agg(F.count("*").alias("k"), F.count_if(F.col("pos") == 0).alias("rows"))
    real = F.col("word") != ""
    total = F.sum(F.when(real, F.col("k")).otherwise(0))
    return by_word.groupBy("doc_id", "h1", "h2").agg((total / F.sum("rows")).cast("long").alias("words"), F.count_if(real).alias("distinct_words"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i fails), good, toxic of every row."""
    known = _documents(docs)
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    rows = known.select("doc_id", "part", "h1", "h2", (100 * capitals > CAPITALS * F.char_length("text")).alias("fails_c"), F.col("text").rlike(MARKS).alias("fails_d"))
    counts = word_counts(known).withColumnsRenamed({"doc_id": "counted", "h1": "w1", "h2": "w2"})
    own = rows["doc_id"].eqNullSafe(F.col("counted")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    least = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))))
    met = rows.join(least, ["h1", "h2"], "left").join(counts, own, "left").join(marks, rows["doc_id"] == F.col("labelled"), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < WORDS, 100 * distinct < DISTINCT * words, F.col("fails_c"), F.col("fails_d"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return met.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histogram(flags: DataFrame) -> DataFrame:
    """For each part the 32 counts of all, good and toxic documents, as arrays n, good and toxic."""
    hit = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.sum(F.when(F.col("mask") == m, hit[k]).otherwise(0)).cast("long").alias(f"{k}{m}") for k in _KINDS for m in range(MASKS)]
    return flags.groupBy("part").agg(*columns).select("part", *(F.array(*(f"{k}{m}" for m in range(MASKS))).alias(k) for k in _KINDS))


def orders() -> Column:
    """All orders of the filters, each an array of bit numbers."""
    n = len(FILTERS)
    digits = lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(x / F.pow(F.lit(n), i)).cast("int") % n)
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n**n - 1)), digits), lambda o: F.size(F.array_distinct(o)) == n)


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order."""
    power = lambda i: F.element_at(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), i + 1)
    letter = lambda i: F.substring(F.lit(FILTERS), i + 1, F.lit(1))
    steps = (
        counts.select("*", F.explode(orders()).alias("o"))
        .select("*", F.array_join(F.transform("o", letter), "").alias("filter_order"), F.posexplode("o").alias("pos", "at"))
        .withColumn("before", F.aggregate(F.slice("o", F.lit(1), F.col("pos")), F.lit(0), lambda a, i: a + power(i)))
        .withColumn("bit", power(F.col("at")))
    )
    bit, before = F.col("bit"), F.col("before")
    total = lambda xs, keep: F.aggregate(F.transform(xs, lambda x, m: F.when(keep(m), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    fails = lambda m: m.bitwiseAND(bit) != 0
    alive = lambda m: m.bitwiseAND(before) == 0
    share = factorial(len(FILTERS))
    return steps.select(
        "part",
        "filter_order",
        (F.col("pos") + 1).cast("int").alias("step"),
        total("n", lambda m: alive(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: alive(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~alive(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: alive(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: alive(m) & fails(m)).alias("toxic_lost"),
        # of the orders, a filter comes first among the k that fail a document in one of k
        F.aggregate(F.transform("n", lambda x, m: F.when(fails(m), x * (F.lit(share) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every order of the five filters, for each language."""
    return interactions(histogram(flagged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))))


_STEPS = ", ".join(f"('{''.join(p)}', {i + 1}, {1 << FILTERS.index(c)}, {sum(1 << FILTERS.index(x) for x in p[:i])})" for p in permutations(FILTERS) for i, c in enumerate(p))
OP13_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS x, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS low, part, len(w) AS n, len(list_distinct(w)) AS d, length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS caps FROM t),
 l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 m AS (SELECT part, (n < 100)::INT + 2 * (100 * d < 80 * n)::INT + 4 * (100 * caps > 10 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(f.doc_id > low, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
 s AS (SELECT part, column0 AS filter_order, column1::INT AS step, column2 AS bit, column3 AS prior, mask, good, toxic FROM m CROSS JOIN (VALUES {_STEPS}) v(column0, column1, column2, column3)),
 r AS (SELECT part, filter_order, step, any_value(bit) AS bit, count(*) FILTER (WHERE mask & (bit | prior) = 0) AS kept, count(*) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0) AS removed, count(*) FILTER (WHERE mask & bit <> 0 AND mask & prior <> 0) AS redundant, count(*) FILTER (WHERE mask = bit) AS unique_fails, count(*) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0 AND good = 1) AS good_lost, count(*) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0 AND toxic = 1) AS toxic_lost FROM s GROUP BY part, filter_order, step)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
