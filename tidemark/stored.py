"""A node over stored tables: databases at any basis of what the streaming ingest wrote.

Nothing is held on the driver. A database at a basis is one aggregation of the versions, a join
with the documents and their JSON read by one schema; queries, pulls and SQL compile against it
as against any entity table. History and single entities are reads of one entity, which the
files' order by entity prunes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.db import Db
from tidemark.model import Basis, Catalog, EntityTable
from tidemark.node import OutOfSync, Watched, _naive, _now
from tidemark.operators.temporal import as_of
from tidemark.operators.text import TextIndex
from tidemark.plans.compile import literal
from tidemark.streaming.ingest import LOG, LogIngest, documents_of, evict, fold_log


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """One type for the values of both: numbers become doubles, structs and arrays merge, all else is text."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a}
        for f in b:
            kinds[f.name] = merge(kinds.get(f.name, T.NullType()), f.dataType)
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    return T.StringType()


def plain(kind: T.DataType) -> T.DataType:
    """Decimals of JSON numbers as doubles, and text where no value was seen."""
    if isinstance(kind, T.DecimalType):
        return T.LongType() if kind.scale == 0 and kind.precision < 19 else T.DoubleType()
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in kind])
    return kind


class StoredNode(Watched):
    """The tables of a LogIngest as a node. `types` declares attributes that JSON has as text, such as times: {"ts": "timestamp"}. `text` is a stored index of the documents."""

    def __init__(self, spark: SparkSession, path: str, types: dict[str, str] | None = None, functions: dict[str, Callable] | None = None, aggregates: dict[str, Callable] | None = None, fn_allow_list: set[str] | None = None, timeout_ms: int = 30_000, text: TextIndex | None = None) -> None:
        super().__init__()
        self.spark, self.types, self.functions, self.aggregates, self.allowed, self.timeout_ms, self.text = spark, types or {}, functions or {}, aggregates or {}, fn_allow_list, timeout_ms, text
        self.ingest = LogIngest(spark, path, [lambda e: self._tell("indexed-tx", e)])

    def submit(self, log: DataFrame) -> dict | None:
        """Fold a log (see tidemark.streaming.ingest.LOG) of later transactions into the tables."""
        last = self.ingest.stored.last_order()
        self.ingest.batch(log, 0 if last is None else last + 1)
        return self.latest_completed_tx()

    def latest_completed_tx(self) -> dict | None:
        seen = self.ingest.transactions.read()
        row = seen.agg(F.max_by(F.struct("tx_id", "tx_time"), "tx_id").alias("t")).first()["t"] if seen is not None else None
        return {"tx_id": row["tx_id"], "tx_time": row["tx_time"]} if row else None

    def open_tx_log(self, after_tx_id: int | None = None) -> DataFrame:
        """(tx_id, tx_time, ops) of the transactions in order."""
        seen = self.ingest.transactions.read()
        if seen is None:
            return self.spark.createDataFrame([], "tx_id long, tx_time timestamp, ops long")
        return (seen if after_tx_id is None else seen.where(F.col("tx_id") > after_tx_id)).orderBy("tx_id")

    def _basis(self, valid_time: datetime | None, tx_time: datetime | None, tx_id: int | None) -> Basis:
        valid_time, tx_time, last = _naive(valid_time), _naive(tx_time), self.latest_completed_tx()
        if tx_id is not None and (last is None or tx_id > last["tx_id"]):
            raise OutOfSync(f"transaction {tx_id} is not indexed")
        if tx_time is not None:
            if last is None or tx_time > last["tx_time"]:
                raise OutOfSync(f"time {tx_time} is not indexed")
            at = self.ingest.transactions.read().where(F.col("tx_time") <= F.lit(tx_time)).agg(F.max("tx_id")).first()[0]
            at = -1 if at is None else at
            if tx_id is not None and at != tx_id:
                raise ValueError("tx_id and tx_time name different transactions")
            tx_id = at
        return Basis(valid_time or _now(), tx_time, last["tx_id"] if tx_id is None and last else -1 if tx_id is None else tx_id)

    def schema(self) -> T.StructType:
        """The attributes of all documents, from what each batch noted of its own."""
        stored = self.ingest.schemas.read()
        out: T.DataType = T.StructType([])
        for row in stored.select("kinds").distinct().collect() if stored is not None else []:
            # A schema string names structs OBJECT.
            kind = self.spark.range(0).select(F.from_json(F.lit("{}"), f"STRUCT<x: {row['kinds'].replace('OBJECT<', 'STRUCT<')}>").alias("s")).schema["s"].dataType["x"].dataType
            out = merge(out, kind) if isinstance(kind, T.StructType) else out
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(self.types[f.name]) if f.name in self.types else plain(f.dataType)) for f in out])

    def table(self, versions: DataFrame, documents: DataFrame, basis: Basis) -> EntityTable:
        schema = self.schema()
        alive = as_of(versions, basis.valid_time, basis.tx_id, payload=["content_hash"], alive="content_hash").select("eid", "content_hash")
        docs = documents.select("content_hash", "doc").dropDuplicates(["content_hash"])
        held = alive.join(docs, "content_hash").select(F.col("eid").alias("_id"), F.from_json("doc", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"}).alias("d"))
        names = [f.name for f in schema if f.name != "_id"]
        return EntityTable("documents", held.select("_id", *[F.col(f"d.`{n}`").alias(n) for n in names]), "_id", {n: n for n in names})

    def db(self, valid_time: datetime | None = None, tx_time: datetime | None = None, tx_id: int | None = None) -> Db:
        """The database at a valid time (now, if none is given) as known at a transaction (the last, if none is given)."""
        basis = self._basis(valid_time, tx_time, tx_id)
        return self._at(self.ingest.versions(), self._documents(), basis)

    open_db = db

    def _documents(self) -> DataFrame:
        docs = self.ingest.documents.read()
        return docs if docs is not None else self.spark.createDataFrame([], "content_hash string, eid string, doc string")

    def _at(self, versions: DataFrame, documents: DataFrame, basis: Basis) -> Db:
        catalog = Catalog(text=self.text).add(self.table(versions, documents, basis))
        return Db(self.spark, catalog, basis, self, self.functions, self.aggregates, self.allowed, timeout_ms=self.timeout_ms)

    def versions_of(self, eid: object, basis: Basis) -> list[dict]:
        rows = self.ingest.versions().where(F.col("eid") == str(literal(eid)))
        rows = rows.where(F.col("tx_id") <= basis.tx_id) if basis.tx_id is not None else rows
        return [{"valid_time": r["vt"], "tx_time": r["tt"], "tx_id": r["tx_id"], "content_hash": r["content_hash"]} for r in rows.collect()]

    def documents_at(self, marks: list[str]) -> dict[str, dict]:
        rows = self._documents().where(F.col("content_hash").isin(list(set(marks)))).select("content_hash", "doc").distinct().collect()
        return {r["content_hash"]: json.loads(r["doc"]) for r in rows}

    def speculate(self, basis: Basis, ops: list[tuple]) -> Db:
        """The database with puts and deletes on the side: ("put", document, start, end) and ("delete", id, start, end)."""
        tx_id, now = (basis.tx_id if basis.tx_id is not None else -1) + 1, _now()
        rows = []
        for k, (kind, what, *times) in enumerate(ops):
            if kind not in ("put", "delete"):
                raise ValueError(f"{kind} needs a node that decides transactions")
            start, end = [*map(_naive, times), None, None][:2]
            eid = what["_id"] if kind == "put" else what
            rows.append((tx_id, now, k, kind, str(literal(eid)), start, end, json.dumps(what) if kind == "put" else None))
        log = self.spark.createDataFrame(rows, LOG)
        versions = self.ingest.versions()
        versions = versions.where(F.col("tx_id") <= basis.tx_id) if basis.tx_id is not None else versions
        documents = self._documents().unionByName(documents_of(log))
        return self._at(evict(fold_log(log, versions), log), documents, Basis(max(filter(None, (basis.valid_time, now))), None, tx_id))

    def attribute_stats(self) -> dict[str, int]:
        return self.db().attribute_stats()

    def status(self) -> dict:
        return {"latest_tx": self.latest_completed_tx(), "documents": self._documents().select("content_hash").distinct().count(), "entities": self.ingest.versions().select("eid").distinct().count()}
