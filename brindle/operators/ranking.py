"""Ranks, batches and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turn_order(rows: DataFrame, session: str, order: list[Column], name: str) -> DataFrame:
    """(session, n, turn_order): members in order, joined."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(*order))
    listed = rows.select(session, F.struct(rank.alias("r"), F.col(name).cast("string").alias("m")).alias("e")).groupBy(session).agg(F.array_sort(F.collect_list("e")).alias("l"))
    return listed.select(session, F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda e: e.m), ",").alias("turn_order"))


def next_alive(rows: DataFrame, session: str, position: Column, current: Column, size: Column, alive: Column, take: int = 1) -> DataFrame:
    """The next ``take`` living members after ``current``, going round; wrapped tells
    that the count began anew."""
    distance = F.pmod(position - current - 1, size)
    found = rows.withColumn("distance", distance).filter(alive)
    rank = F.row_number().over(W.partitionBy(session).orderBy("distance", position))
    return found.withColumn("place", rank).filter(F.col("place") <= take).withColumn("wrapped", position <= current)


def batches(rows: DataFrame, group: list[str], order: str, size: int, ties: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """Numbers rows in batches of ``size`` within each group, by a numeric column.

    A group is numbered in up to ``ranges`` ranges of the column, one task each, and
    what comes before a range is counted, so a group of any size is no single task.
    Null orders come first."""
    cuts = rows.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("c")).first()["c"] or []
    range_of = F.coalesce(F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(order))), F.lit(0)) if cuts else F.lit(0)
    ranged = rows.withColumn("__range", range_of)
    # at most ``ranges`` rows a group
    counts = ranged.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    keys = {c: f"__k{i}" for i, c in enumerate([*group, "__range"])}
    offsets = counts.select(*(F.col(c).alias(k) for c, k in keys.items()), before.alias("__before"))
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    met = ranged.join(offsets, same).drop(*keys.values())
    rank = F.row_number().over(W.partitionBy(*group, "__range").orderBy(order, *(ties or []))) + F.col("__before")
    return met.withColumn("batch", F.floor((rank - 1) / size)).drop("__range", "__before")


def dealt(rows: DataFrame, group: str, most: int = 250_000) -> DataFrame:
    """The rows dealt over tasks by group, in as many tasks as it takes for about ``most``
    rows each, so that what a task sorts does not grow with the table.  Windows and joins on
    the group keep this dealing.  A group is not divided."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(tasks, group)


def parts(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds part and n_parts: k of n within a group."""
    by = W.partitionBy(group)
    return rows.withColumn("part", F.row_number().over(by.orderBy(*order))).withColumn("n_parts", F.count("*").over(by))


def part_titles(rows: DataFrame, title: str, doc: str, part: Column, n_parts: Column) -> DataFrame:
    """Adds part_title (F9): the title, which part of how many it is, and the document
    where several documents have the title."""
    several = rows.select(title, doc).distinct().groupBy(title).agg(F.count("*").alias("__docs"))
    told = F.concat(F.col(title), F.when(n_parts > 1, F.concat(F.lit(" (part "), part.cast("string"), F.lit("/"), n_parts.cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("__docs") > 1, F.concat(F.lit(" ["), F.col(doc).cast("string"), F.lit("]"))).otherwise(""))
    return rows.join(several, title).withColumn("part_title", told).drop("__docs")


def roster(rows: DataFrame, session: str, order: list[Column], shown: int, alive: Column) -> DataFrame:
    """(session, shown, active, down): how many of the members after the first ``shown``
    are up and down (E17, F10).

    Members are counted by session; only its first ``shown`` are ever ranked, of which each
    task leaves no more, and taken off the counts."""
    told = rows.select(session, alive.alias("__up"), F.row_number().over(W.partitionBy(session).orderBy(*order)).alias("__r"))
    first = told.filter(F.col("__r") <= shown).groupBy(F.col(session).alias("__s")).agg(F.count("*").alias("shown"), F.count_if("__up").alias("__a"), F.count_if(~F.col("__up")).alias("__d"))
    counts = rows.groupBy(session).agg(F.count_if(alive).alias("active"), F.count_if(~alive).alias("down"))
    met = counts.join(first, F.col(session).eqNullSafe(F.col("__s")), "left")
    off = lambda c, k: (F.col(c) - F.coalesce(F.col(k), F.lit(0))).alias(c)
    return met.select(session, F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), off("active", "__a"), off("down", "__d"))


def tail(log: Column, n: int = 20) -> Column:
    """The last ``n`` elements of an array, or all if it has fewer."""
    return F.slice(log, F.greatest(F.size(log) - n + 1, F.lit(1)), n)


def nested(parent: DataFrame, child: DataFrame, key: str, columns: list[str], into: str) -> DataFrame:
    """Each parent with its children as a sorted array of structs; empty without any."""
    grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(into))
    return parent.join(grouped, key, "left").withColumn(into, F.coalesce(into, F.array().cast(grouped.schema[into].dataType)))
