"""The registry that the query modules fill."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where rounds of a crawl are written: a folder of our own below spark.checkpoint.dir,
    which the driver and all executors share; below a folder of this machine only where
    Spark runs on it alone.  It goes when the driver's Python ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not top and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{top or f'file://{tempfile.gettempdir()}/brindle'}/{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove)
    _FOLDERS.append((spark, folder))
    return folder


_FOLDERS: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    """Deletes the folders given out, when the driver's Python ends."""
    for spark, folder in _FOLDERS:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop
            path = hadoop.fs.Path(folder)
            path.getFileSystem(hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001  the driver's JVM is gone: what is left is a folder of files
            pass


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
