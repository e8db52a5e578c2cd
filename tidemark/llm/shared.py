"""What the operators share: tables in the cluster's shared folder, size-checked broadcasts, and Python tasks that hold little memory."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one or two integer columns that may be broadcast; the count is measured first.
BROADCAST_ROWS = 400_000

#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 8 << 20

_own_root: str | None = None


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Hand freed memory back to the system: a worker that is kept for later tasks keeps nothing of this one."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def over(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)))) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and everything runs in one process, a temporary folder; an error on a cluster."""
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_root


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark's file system gives it, so that other readers find the same place."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    return re.sub(r"^file:/+", "file:///", whole)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables that cut lineage: written as Parquet to the shared folder, so that a lost executor costs no earlier stage.

    The folder goes when the driver ends; drop() frees a table sooner.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self._made: dict[int, str] = {}
        self._tables: list[str] = []
        atexit.register(self._end)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._made[id(out)] = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Cut by a table that is dealt by `key` already, so that what meets it by that key shuffles the other side only."""
        name = f"tidemark_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", self.folder(name)).saveAsTable(name)
        self._tables.append(name)
        return self.spark.table(name)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := self._made.pop(id(df), None):
                delete(self.spark, path)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for name in self._tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                delete(self.spark, self.path)
        except Exception:  # the session ended first; the folder is the cluster's to clear
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one column, distinct): by broadcast while ids is measured to be small, else by a shuffle."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def words_of(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")
