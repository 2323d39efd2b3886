"""Readers (A1-A10, A12-A15) and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, holds anything; any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array; no rows if it is missing."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else empty(spark, schema)


def json_outputs(spark: SparkSession, folder: str, schema: T.StructType, category: str = "category") -> DataFrame:
    """All JSON arrays of a folder; the file's stem is the category, files of parse
    errors are passed over."""
    path = f"{folder}/*.json"
    if not exists(spark, path):
        return empty(spark, T.StructType([*(f for f in schema.fields if f.name != category), T.StructField(category, T.StringType())]))
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("__stem", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    return rows.filter(~F.col("__stem").endswith("_parse_errors")).drop(category).withColumnRenamed("__stem", category)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON object a line; blank lines are passed over."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else empty(spark, schema)


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_name, text) of files read whole, as pages or Markdown."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    if not exists(spark, pattern):
        return empty(spark, T.StructType([T.StructField("file_name", T.StringType()), T.StructField("text", T.StringType())]))
    return spark.read.schema(schema).text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


CHECKPOINT = T.StructType(
    [
        T.StructField("completed", T.ArrayType(T.StringType())),
        T.StructField("failed", T.MapType(T.StringType(), T.StringType())),
        T.StructField("pending", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


def checkpoint_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sets and maps of a crawl checkpoint as tables."""
    doc = json_array(spark, path, CHECKPOINT)
    return {
        "completed": doc.select(F.explode("completed").alias("url")),
        "failed": doc.select(F.explode("failed").alias("url", "error")),
        "pending": doc.select(F.explode("pending").alias("category", "urls")).select("category", F.explode("urls").alias("url")),
    }


def table_or(spark: SparkSession, name: str, fallback: DataFrame) -> DataFrame:
    """A catalogued table, or the fallback where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, is_temporary) of the tables and views there are."""
    rows = [(t.name, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, is_temporary boolean")


def has_function(spark: SparkSession, name: str) -> bool:
    """Whether a function, built in or registered, exists."""
    return spark.catalog.functionExists(name)


def ready(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def write_json(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """JSON lines, committed as one job; ``by`` makes a folder for each value."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def append_run(df: DataFrame, path: str, at: Column) -> None:
    """Adds rows to a run history, with the time given."""
    df.withColumn("run_at", at).write.mode("append").json(path)
