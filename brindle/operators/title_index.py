"""An index of titles by trigrams, for many search terms at once.

Every title has a posting for each of its trigrams, in lower case; two marks at its end let
terms of one or two characters meet the beginning of a trigram.  A term looks up its
rarest trigram alone, as every title that contains the term has it, and what is found is
verified.  So a trigram that a third of the titles have is only read for terms that have no
rarer one.

Where many titles have the same text, the text may be the key: the index is then one of
texts, and every title takes what its text has found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fills the last trigrams; no title has it.
END = "\x01"
#: Titles found for a term that join the askers of the term at once; more go in runs of so many.
RUN = 1024
#: Askers of a term in one list.
LIST = 128


def _grams(text: Column, n: Column) -> Column:
    """The distinct trigrams of a text, from its first ``n`` places."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(3))))


def postings(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(gram, key): a row for each distinct trigram of each title; null and empty titles
    have none."""
    low = F.lower(F.col(title))
    rows = titles.filter(F.coalesce(F.char_length(title), F.lit(0)) > 0).select(key, F.explode(_grams(F.concat(low, F.lit(END * 2)), F.char_length(low))).alias("gram"))
    return rows.select("gram", key)


def search(index: DataFrame, titles: DataFrame, terms: DataFrame, key: str, title: str, order: list[str], limit: int | None = 3, page: str | None = None) -> DataFrame:
    """(term_id, place, tier, columns of titles): the titles that contain each term (term_id,
    term), case aside: exact ones (tier 1), those that begin with it (2), others (3), each
    in ``order``; at most ``limit`` for a term, or all.  ``key`` of the index may be one of
    several titles, where they have the same text.

    ``page`` names a column of which every value counts once for a term, with its first
    title in ``order`` (F2).  Null and empty terms find nothing; equal terms are terms
    of their own."""
    asked = terms.select("term_id", F.lower("term").alias("term")).filter("term <> ''").withColumn("size", F.char_length("term"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    long = asked.filter("size >= 3").select("term", F.explode(_grams(F.col("term"), F.col("size") - 2)).alias("gram")).distinct()
    rarest = long.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(index, "gram").select("term", key)
    # a short term is the beginning of a trigram
    for n in (1, 2):
        short = asked.filter(F.col("size") == n).select("term").distinct()
        met = met.union(short.join(index.select(F.left("gram", F.lit(n)).alias("term"), key), "term").select("term", key).distinct())
    known = met.join(titles, key)
    low = F.lower(F.col(title))
    tier = F.when(low == F.col("term"), 1).when(low.startswith(F.col("term")), 2).when(low.contains(F.col("term")), 3)
    hits = known.withColumn("tier", tier).filter("tier is not null")
    if page is not None:
        first = F.row_number().over(W.partitionBy("term", page).orderBy(*order))
        hits = hits.withColumn("__first", first).filter("__first = 1").drop("__first")
    place = F.row_number().over(W.partitionBy("term").orderBy("tier", *order))
    ranked = hits.withColumn("place", place)
    ranked = ranked if limit is None else ranked.filter(F.col("place") <= limit)
    # a term that many ask for and many titles contain meets its titles in runs of places, so
    # that its rows are dealt over the tasks; a title meets its askers in lists, so that a row
    # of the result is an element of a list and not a row of a join
    turn = F.floor((F.row_number().over(W.partitionBy("term").orderBy("term_id")) - 1) / LIST)
    askers = asked.select("term", "term_id", turn.alias("__turn")).groupBy("term", "__turn").agg(F.collect_list(F.struct("term_id")).alias("__askers"))
    last = F.col("n") if limit is None else F.least("n", F.lit(limit))
    most = hits.groupBy("term").agg(F.count("*").alias("n"))
    runs = askers.join(most, "term").select("term", "__askers", F.explode(F.sequence(F.lit(0), F.floor((last - 1) / RUN).cast("int"))).alias("run"))
    runs = runs.select("__askers", F.struct("term", "run").alias("__run"))
    ranked = ranked.withColumn("__run", F.struct("term", F.floor((F.col("place") - 1) / RUN).cast("int").alias("run"))).drop("term")
    if limit is None:
        ranked = ranked.repartition(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__run")
    # one key and a merge keep this dealing, however small a side is
    return ranked.hint("merge").join(runs, "__run").select(F.inline("__askers"), "place", "tier", *titles.columns)
