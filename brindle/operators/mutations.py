"""Snapshot mutations (B5-B15, P7-P9, P12): a table in, the next version out.

There is no table format with MERGE here, so every mutation is a plan from one
snapshot to the next; writing the result is one atomic step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Values that the ranges of a numbering are cut from at most.
CUTS = 10_000


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` replace those of equal keys and are added otherwise.
    Repeated keys in ``source``: use last_of first."""
    return target.join(source, keys, "left_anti").unionByName(source)


def last_of(source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key."""
    rest = [c for c in source.columns if c not in keys]
    picked = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return picked.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The next snapshot, and one row of inserted and skipped counts."""
    fresh = source.join(target, keys, "left_anti")
    counts = source.join(target.select(*keys).distinct().withColumn("__there", F.lit(True)), keys, "left").agg(
        F.count_if(F.col("__there").isNull()).alias("inserted"), F.count_if(F.col("__there")).alias("skipped")
    )
    return target.unionByName(fresh), counts


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Changes columns of the rows where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def cascade(child: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows of a child table that survive deleted parents."""
    return child.join(deleted.select(F.col(key).alias(foreign)), foreign, "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """Child rows keep, but lose their link to, deleted parents."""
    gone = deleted.select(F.col(key).alias(foreign), F.lit(True).alias("__gone")).distinct()
    return child.join(gone, foreign, "left").withColumn(foreign, F.when(F.col("__gone").isNull(), F.col(foreign))).drop("__gone")


def stack(table: DataFrame, added: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Equal keys add up their quantity."""
    return table.select(*keys, quantity).unionByName(added.select(*keys, quantity)).groupBy(*keys).agg(F.sum(quantity).alias(quantity))


def use_one(table: DataFrame, condition: Column, quantity: str) -> DataFrame:
    """One less where the condition holds; what reaches 0 goes."""
    return update_where(table, condition, {quantity: F.col(quantity) - 1}).filter(F.col(quantity) > 0)


def select_one(table: DataFrame, owner: Column, chosen: Column, flag: str) -> DataFrame:
    """YES for the chosen row of an owner, NO for its others."""
    return update_where(table, owner, {flag: F.when(chosen, "YES").otherwise("NO")})


def equip(slot: Column, equipped: Column, chosen: Column, wanted: str) -> tuple[Column, Column]:
    """(equipped, slot) of an owner's rows after ``chosen`` is put in slot ``wanted``.

    A row worn in the same slot comes off and has no slot any more; one that fits either
    slot moves to the other; wanting either takes the whole set off.  Rows that are not
    worn stay as they are."""
    other = "DEFENSE" if wanted == "OFFENSE" else "OFFENSE"
    off = equipped & ((slot == wanted) | (F.lit(wanted) == "ADAPTIVE"))
    moves = equipped & (slot == "ADAPTIVE")
    off, moves = (F.coalesce(c, F.lit(False)) for c in (off, moves))
    return F.when(chosen, True).when(off, False).otherwise(equipped), F.when(chosen, wanted).when(off, F.lit(None).cast("string")).when(moves, other).otherwise(slot)


def insert_returning(target: DataFrame, source: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The next snapshot, and the new rows with the keys they were given (B7): the
    numbers after the greatest there is, in the given order.

    The rows are numbered in ranges of the first column of the order, a task for each, after
    the rows of the ranges before are counted; the ranges' cuts come from at most
    CUTS of its values."""
    last = target.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
    width = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = source.select(F.col(order[0]).alias("v")).filter("v is not null").orderBy(F.xxhash64("v")).limit(CUTS)
    values = [r["v"] for r in some.distinct().orderBy("v").collect()]
    cuts = values[:: max(1, -(-len(values) // width))][1:]
    ranged = source.withColumn("__range", F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order[0]))), F.lit(0)) if cuts else F.lit(0))
    ranged = ranged.withColumn("__range", F.when(F.col(order[0]).isNull(), 0).otherwise(F.col("__range")))
    # a row for each range
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offset = F.element_at(F.array(*map(F.lit, before)), F.col("__range") + 1)
    number = F.row_number().over(W.partitionBy("__range").orderBy(*order)) + offset + last
    fresh = ranged.withColumn("__key", number.cast(target.schema[key].dataType)).drop(key).withColumnRenamed("__key", key).drop("__range")
    fresh = fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    return target.unionByName(fresh), fresh


def swap(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the next snapshot of several tables and then, in one step, makes it the
    present one (B15): readers see all of it or nothing.

    Each snapshot is a folder of its own; the file CURRENT, replaced by a rename, names
    the one that holds."""
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    context = hadoop.fs.FileContext.getFileContext(hadoop.fs.Path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fresh = hadoop.fs.Path(f"{folder}/CURRENT.{name}")
    out = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fresh)
    out.writeBytes(name)
    out.close()
    rename = hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context.rename(fresh, hadoop.fs.Path(f"{folder}/CURRENT"), overwrite)


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the snapshot that holds."""
    name = spark.read.text(f"{folder}/CURRENT").first()["value"]
    return spark.read.parquet(f"{folder}/{name}/{table}")


def snapshot(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table of the snapshot that holds; an empty one of ``schema`` before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    path = hadoop.fs.Path(f"{folder}/CURRENT")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return current(spark, folder, table)


def sync(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert, update, unchanged or deleted, by comparing digests."""
    a = old.select(F.col(key), F.col(digest).alias("__old"), F.lit(True).alias("__a"))
    b = new.select(F.col(key), F.col(digest).alias("__new"), F.lit(True).alias("__b"))
    action = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "deleted").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("update")
    return a.join(b, key, "full").select(key, action.alias("action"))


def sync_versions(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """The next snapshot of a table of versioned rows (P12): columns key, digest, version
    and deleted of ``old``.  Rows that are new start at version 1, changed ones count on,
    those that disappeared are marked deleted, those that came back live again."""
    a = old.select(F.col(key), F.col(digest).alias("__old"), F.col("version").alias("__v"), F.col("deleted").alias("__gone"))
    b = new.select(F.col(key), F.col(digest).alias("__new"), F.lit(True).alias("__b"))
    j = a.join(b, key, "full")
    version = F.when(F.col("__v").isNull(), 1).when(F.col("__b").isNotNull() & ~F.col("__old").eqNullSafe(F.col("__new")), F.col("__v") + 1).otherwise(F.col("__v"))
    return j.select(key, F.when(F.col("__b"), F.col("__new")).otherwise(F.col("__old")).alias(digest), version.alias("version"), F.col("__b").isNull().alias("deleted"))


def required(left: DataFrame, right: DataFrame, keys: list[str], probe: str) -> DataFrame:
    """A left join that fails where the right side is missing."""
    joined = left.join(right.withColumn("__there", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no match for "), F.col(probe).cast("string")))
    return joined.withColumn(probe, F.when(F.col("__there").isNull(), missing.cast(left.schema[probe].dataType)).otherwise(F.col(probe))).drop("__there")


def rejected(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the name of the first they break."""
    reason = None
    for name, good in rules.items():
        bad = ~F.coalesce(good, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return rows.withColumn("reason", reason).filter("reason is not null")


def exactly_one(rows: DataFrame):
    """The only row; an error if there is none or more than one."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"expected one row, found {'none' if not found else 'several'}")
    return found[0]
