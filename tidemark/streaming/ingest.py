"""Ingest of a log of puts and deletes into version tables, as a batch or a stream.

A log row is (tx_id, tx_time, op_idx, op, eid, vt, end_vt, doc). Entities are independent, so
each is folded by itself, in order of (tx_id, op_idx); a transaction that depends on others
(match, cas, functions) goes through a node instead. Late and retroactive rows are nothing
special: they are puts with an old valid time, and no watermark ever drops one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.temporal import as_of, fold_put, layout
from tidemark.sources.stores import TableStore

LOG = "tx_id bigint, tx_time timestamp, op_idx int, op string, eid string, vt timestamp, end_vt timestamp, doc string"
VERSIONS = "eid string, vt timestamp, tt timestamp, tx_id bigint, content_hash string"
FOLDED_VERSIONS = "eid string, vt bigint, tt bigint, tx_id bigint, content_hash string"


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds entities whose rows (eid, old, tx_id, op_idx, vt, end_vt, tt, content_hash) come one after another, however they lie in batches: old versions first, then operations in order. Times are microseconds, a null hash is a deletion."""
    made = pa.schema([("eid", pa.string()), ("vt", pa.int64()), ("tt", pa.int64()), ("tx_id", pa.int64()), ("content_hash", pa.string())])

    def folded(rows: Iterable[tuple]) -> Iterator[tuple]:
        for eid, mine in groupby(rows, key=lambda r: r[0]):
            existing: list[tuple] = []
            for _, old, tx_id, _, vt, end, tt, content in mine:
                if old:
                    existing.append((vt, tt, tx_id, content))
                    continue
                for row in fold_put(existing, tt if vt is None else vt, end, tt, tx_id, content):
                    existing = [v for v in existing if (v[0], v[2]) != (row[0], row[2])] + [row]
            yield from ((eid, *v) for v in existing)

    found = folded(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    while some := list(islice(found, 10_000)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), made, strict=True)], schema=made)


def fold_log(log: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """The versions after a log's puts and deletes, those before included.

    An operation without end adds one version, whatever came before, unless a version that is
    visible at its start has others of the same transaction after it. So entities of which no
    operation has an end and no transaction more than one stay native; only the others are
    folded one by one, as each of their operations depends on those before: sorted by entity, so
    that a task streams through as many as it has.
    """
    spark = log.sparkSession
    new = log.where("op IN ('put', 'delete')").select("eid", "vt", "tx_time", "tx_id", "op_idx", "op", "end_vt", F.when(F.col("op") == "put", F.sha1(F.col("doc").cast("binary"))).alias("content_hash"), F.lit(False).alias("old"))
    before = versions if versions is not None else spark.createDataFrame([], VERSIONS)
    several = new.groupBy("eid", "tx_id").agg(F.count("*").alias("c"), F.count("end_vt").alias("ends")).where("c > 1 OR ends > 0").select("eid")
    if versions is not None:
        twice = before.groupBy("eid", "tx_id").agg(F.count("*").alias("c")).where("c > 1").select("eid")
        several = several.union(twice.join(new, "eid", "left_semi"))
    several = several.distinct()
    plain = new.join(several, "eid", "left_anti").select("eid", F.coalesce("vt", "tx_time").alias("vt"), F.col("tx_time").alias("tt"), "tx_id", "content_hash")
    old = before.select("eid", "vt", F.col("tt").alias("tx_time"), "tx_id", F.lit(0).alias("op_idx"), F.lit("put").alias("op"), F.lit(None).cast("timestamp").alias("end_vt"), "content_hash", F.lit(True).alias("old"))
    rows = new.unionByName(old).join(several, "eid", "left_semi")
    micros = {n: F.unix_micros(F.col(x).cast("timestamp")) for n, x in (("vt", "vt"), ("end_vt", "end_vt"), ("tt", "tx_time"))}
    rows = rows.select("eid", "old", "tx_id", "op_idx", *[c.alias(n) for n, c in micros.items()], F.when(F.col("op") == "put", F.col("content_hash")).alias("content_hash"))
    rows = rows.repartition("eid").sortWithinPartitions("eid", F.desc("old"), "tx_id", "op_idx")
    rest = rows.mapInArrow(_fold, FOLDED_VERSIONS).select("eid", F.timestamp_micros("vt").alias("vt"), F.timestamp_micros("tt").alias("tt"), "tx_id", "content_hash")
    return before.join(several, "eid", "left_anti").unionByName(plain).unionByName(rest)


def documents_of(log: DataFrame) -> DataFrame:
    """(content_hash, eid, doc) of each distinct document."""
    return log.where("op = 'put'").select(F.sha1(F.col("doc").cast("binary")).alias("content_hash"), "eid", "doc").dropDuplicates(["content_hash"])


def evict(versions: DataFrame, log: DataFrame) -> DataFrame:
    """versions without those of evicted entities, in the past too, up to the eviction."""
    gone = log.where("op = 'evict'").groupBy("eid").agg(F.max("tx_id").alias("gone"))
    return versions.join(gone, "eid", "left").where("gone IS NULL OR tx_id > gone").drop("gone")


def latest_versions(stored: DataFrame) -> DataFrame:
    """Of each entity the versions that its last batch wrote; a batch that left none wrote a row without valid time."""
    last = stored.groupBy("eid").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["eid", "batch"]).where("vt IS NOT NULL").drop("batch")


class LogIngest:
    """A stream of log files folded into tables under a path, a micro-batch at a time; a batch that runs again changes nothing.

    A batch reads and writes the entities that it touches only: it adds all their versions anew,
    and readers take each entity's last batch. compact() makes one base of all.
    """

    def __init__(self, spark: SparkSession, path: str, listeners: list[Callable[[dict], None]] | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.stored, self.documents, self.transactions, self.schemas = (TableStore(spark, f"{self.path}/{n}") for n in ("versions", "documents", "transactions", "schemas"))
        self.listeners = listeners or []

    def versions(self) -> DataFrame:
        stored = self.stored.read()
        return latest_versions(stored) if stored is not None else self.spark.createDataFrame([], VERSIONS)

    def batch(self, log: DataFrame, batch_id: int) -> None:
        log = log.persist()
        try:
            touched = log.select("eid").distinct()
            held = self.versions().join(touched, "eid", "left_semi")
            folded = evict(fold_log(log, held), log).select("eid", "vt", "tt", "tx_id", "content_hash")
            bare = touched.select("eid", *[F.lit(None).cast(t).alias(n) for n, t in (("vt", "timestamp"), ("tt", "timestamp"), ("tx_id", "bigint"), ("content_hash", "string"))])
            self.stored.write(folded.unionByName(bare).withColumn("batch", F.lit(batch_id).cast("long")), batch_id, ["eid", "vt", "tx_id"])
            self.documents.write(documents_of(log), batch_id)
            self.schemas.write(log.where("op = 'put'").agg(F.schema_of_variant_agg(F.try_parse_json("doc")).alias("kinds")), batch_id)
            self.transactions.write(log.groupBy("tx_id").agg(F.min("tx_time").alias("tx_time"), F.count("*").alias("ops")), batch_id)
            last = log.agg(F.max("tx_id"), F.max("tx_time")).first()
        finally:
            log.unpersist()
        for fn in self.listeners:
            fn({"event": "indexed-tx", "batch": batch_id, "tx_id": last[0], "tx_time": last[1]})

    def compact(self) -> None:
        """One base of the current versions, in ranges of eid; what it replaces goes, evicted entities with it."""
        order = self.stored.last_order()
        if order is not None:
            whole = layout(self.versions().withColumn("batch", F.lit(order).cast("long")))
            self.stored.write(whole, order, base=True)
            self.stored.prune()

    def start(self, source: str, available_now: bool = False, trigger: str = "5 seconds") -> StreamingQuery:
        """Tail the Parquet log files in a folder, from where the checkpoint says."""
        stream = self.spark.readStream.schema(LOG).parquet(source)
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/_checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()

    def latest_tx(self) -> int | None:
        seen = self.transactions.read()
        return seen.agg(F.max("tx_id")).first()[0] if seen is not None else None

    def current(self, valid_time: object = None, tx_id: int | None = None) -> DataFrame:
        """(eid, doc) as of a basis."""
        alive = as_of(self.versions(), valid_time, tx_id, payload=["content_hash"], alive="content_hash")
        return alive.join(self.documents.read().select("content_hash", "doc").dropDuplicates(["content_hash"]), "content_hash").select("eid", "vt", "tx_id", "doc")
