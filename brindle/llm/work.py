"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Without one a folder of this machine if
    Spark runs on it alone, as in tests; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/brindle"


def _delete(spark: SparkSession, folder: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    path = hadoop.fs.Path(folder)
    path.getFileSystem(hadoop.conf.Configuration()).delete(path, True)


class Work:
    """Tables written and reread, which cuts lineage and survives lost executors.

    A result is read from its last tables when it is used, so those stay; they go
    with drop(), with close(), or when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def saved(self, df: DataFrame) -> DataFrame:
        if not self.n:
            atexit.register(self.close)
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                _delete(self.spark, folder)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of jobs that are over, which it does when
        the driver's JVM collects its garbage: in a long chain of jobs they would pile up."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Deletes all tables."""
        atexit.unregister(self.close)
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the driver's JVM is gone: what is left is a folder of files
            pass
