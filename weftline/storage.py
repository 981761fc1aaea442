"""Tables in the folder that driver and executors share, which cut lineage and hold what is read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: set[str] = set()  # folders of this application, deleted when the driver's Python ends


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _own(spark: SparkSession, folder: str) -> None:
    def end():
        try:
            delete(spark, folder)
        except (Py4JError, AttributeError, OSError):  # the JVM has gone before; its folder is left
            pass

    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(end)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs one read.

    put() writes and rereads; drop() deletes a table that only other written tables were made from. Results may still read
    what is left, so the application's folder goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        folder = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"
        _own(spark, folder)
        self.base = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t)))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a written table after counting it; beyond max_rows the join stays a shuffle join (split by AQE if skewed)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
