"""Log, document and version tables on any path that Spark reads: local, HDFS, S3, Azure or Google storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.workspace import delete


class TableStore:
    """A folder of generations of one table, each either an addition or a base that stands for all before it.

    A generation counts once its pointer is there, so readers never see half of one. Orders are
    batch or transaction numbers; a repeated write of the same one changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pointers")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(fs_path))

    def _live(self, order: int | None = None) -> list[str]:
        found = [g for g in self._generations() if order is None or int(g.split("-")[0]) <= order]
        bases = [k for k, g in enumerate(found) if g.split("-")[1] == "base"]
        return found[bases[-1] :] if bases else found

    def write(self, df: DataFrame, order: int, sort: list[str] | None = None, base: bool = False) -> None:
        kind = "base" if base else "add"
        name = f"{order:020d}-{kind}-"
        if any(g.startswith(name) for g in self._generations()):
            return
        folder = f"{name}{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{self.path}/{folder}")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pointers/{folder}")
        fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(fs_path, False).close()

    def read(self, order: int | None = None) -> DataFrame | None:
        """All rows up to an order."""
        found = self._live(order)
        return self.spark.read.parquet(*[f"{self.path}/{g}" for g in found]) if found else None

    def last_order(self) -> int | None:
        found = self._generations()
        return int(found[-1].split("-")[0]) if found else None

    def prune(self) -> None:
        """Delete what a base stands for."""
        live = set(self._live())
        for g in self._generations():
            if g not in live:
                delete(self.spark, f"{self.path}/_pointers/{g}")
                delete(self.spark, f"{self.path}/{g}")


def read_jdbc_log(spark: SparkSession, url: str, table: str = "tx_events", **options: str) -> DataFrame:
    """A relational log (event_offset, event_key, tx_time, topic, v, compacted): its transactions and documents, in ranges of the offset if bounds are given."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where("compacted = 0")


def write_jdbc_log(log: DataFrame, url: str, table: str = "tx_events", **options: str) -> None:
    log.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_kafka_log(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A single-partition topic as a stream: the offset is the transaction id. Needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load()
    return raw.select(F.col("offset").alias("tx_id"), F.col("timestamp").alias("tx_time"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def latest_by_key(records: DataFrame, key: str = "key", order: str = "offset") -> DataFrame:
    """A compacted topic: the last record of each key; null values are deletions."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), order).alias("r")).select(key, "r.*").where("value IS NOT NULL")
