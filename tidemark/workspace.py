"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all runs in one process; an error on a cluster."""
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_root


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_used: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: later plans start from there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _used[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in _used.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session ended first
            return
