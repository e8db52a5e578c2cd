"""A database value: a catalog at one point in both times, with the query, pull, entity and history verbs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.edn import Call, Symbol
from tidemark.model import Basis, Catalog
from tidemark.operators import text
from tidemark.operators.pull import assemble
from tidemark.plans.compile import Compiler, bind_inputs, literal
from tidemark.plans.parse import Query, parse

if TYPE_CHECKING:
    from tidemark.node import Node
    from tidemark.stored import StoredNode


class Db:
    def __init__(self, spark: SparkSession, catalog: Catalog, basis: Basis | None = None, node: Node | StoredNode | None = None, functions: dict[str, Callable] | None = None, aggregates: dict[str, Callable] | None = None, allowed: set[str] | None = None, constraints: dict[str, Callable] | None = None, nullsafe: bool = False, timeout_ms: int = 30_000) -> None:
        self.spark, self.catalog, self.basis, self.node = spark, catalog, basis or Basis(), node
        self.functions, self.aggregates, self.allowed = functions or {}, aggregates or {}, allowed
        self.constraints = {**text.CONSTRAINTS, **(constraints or {})}
        self.nullsafe, self.timeout_ms = nullsafe, timeout_ms

    # Queries.

    def df(self, query: object, *args: object) -> DataFrame:
        """The query's result as a DataFrame; nothing runs but what recursive rules need. Pulls in find stay ids."""
        parsed = parse(query)
        return self._plan(parsed, list(args))[0]

    def _plan(self, query: Query, args: list) -> tuple[DataFrame, list[str]]:
        functions = dict(self.functions)
        plain = []
        for value, binding in zip(args, query.ins, strict=False):
            if callable(value) and not isinstance(value, type):
                functions[binding[1]] = value
                query = Query(**{**query.__dict__, "ins": [b for b in query.ins if b is not binding]})
            else:
                plain.append(value)
        compiler = Compiler(self.spark, self.catalog, query.rules, functions, self.aggregates, self.allowed, self.constraints, self.nullsafe, query.most_rounds)
        return compiler.finish(query, compiler.solve(query.where, bind_inputs(self.spark, query, plain)))

    def q(self, query: object, *args: object) -> set | list:
        """The rows: a set of tuples, or a list where the query orders or pages or names its columns."""
        parsed = parse(query)
        frame, _ = self._plan(parsed, list(args))
        label = str(query)
        rows = self._collect(frame, parsed.timeout if parsed.timeout is not None else self.timeout_ms, label)
        out = [tuple(_value(v) for v in row) for row in rows]
        for k, term in enumerate(parsed.find):
            if isinstance(term, (Call, tuple)) and term[0] == Symbol("pull"):
                ids = [row[k] for row in out]
                pulled = self.pull_many(term[2], ids)
                out = [(*row[:k], p, *row[k + 1 :]) for row, p in zip(out, pulled, strict=True)]
        if parsed.keys:
            return [dict(zip(parsed.keys, row, strict=True)) for row in out]
        try:
            return out if parsed.bag else set(out)
        except TypeError:
            return out

    def open_q(self, query: object, *args: object) -> Iterator[tuple]:
        """Rows as they come, a partition at a time."""
        for row in self.df(query, *args).toLocalIterator():
            yield tuple(_value(v) for v in row)

    def explain(self, query: object, *args: object) -> str:
        return self.df(query, *args)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _collect(self, frame: DataFrame, timeout: int, label: str) -> list[Row]:
        tag = f"tidemark-{uuid.uuid4().hex}"
        late, over = threading.Event(), threading.Event()

        def stop() -> None:
            late.set()
            while not over.is_set():  # a job may start after the first attempt
                self.spark.sparkContext.cancelJobsWithTag(tag)
                over.wait(0.1)

        timer = threading.Timer(timeout / 1000, stop)
        track = self.node.track(label) if self.node else None
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            rows = frame.collect()
            if late.is_set():
                raise TimeoutError(f"query took more than {timeout} ms")
        except Exception as e:
            if track:
                track("failed")
            if late.is_set():
                raise TimeoutError(f"query took more than {timeout} ms") from e
            raise
        finally:
            over.set()
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        if track:
            track("completed")
        return rows

    # Entities.

    def _documents(self, ids: list) -> dict:
        out: dict = {}
        wanted = [literal(i) for i in ids if i is not None]
        for table in self.catalog.tables.values():
            if table.eid is None or not wanted:
                continue
            if "content_hash" in table.df.columns:
                rows = table.df.where(F.col(table.eid).cast("string").isin([str(w) for w in wanted])).select("content_hash", F.col(table.eid).alias("__e")).collect()
                docs = self.node.documents_at([row["content_hash"] for row in rows])
                for row in rows:
                    out[row["__e"]] = {k: _plain(v) for k, v in docs[row["content_hash"]].items()}
            else:
                rows = table.df.where(F.col(table.eid).isin(wanted)).collect()
                for row in rows:
                    doc = out.setdefault(row[table.eid], {"_id": row[table.eid]})
                    doc.update({a: _value(row[col]) for a, col in table.attributes.items() if row[col] is not None})
        return out

    def _referring(self, attribute: str, ids: list) -> dict:
        query = Query(find=[Symbol("e"), Symbol("v")], where=[], ins=[("collection", "v")])
        from tidemark.plans.parse import Triple

        query.where = [Triple(Symbol("e"), attribute, Symbol("v"))]
        out: dict = {}
        for e, v in sorted(self.q(query, [i for i in ids if i is not None]), key=lambda r: str(r[0])):
            out.setdefault(v, []).append(e)
        return out

    def entity(self, eid: object) -> dict | None:
        return self._documents([eid]).get(literal(eid))

    def pull(self, spec: object, eid: object) -> dict:
        return self.pull_many(spec, [eid])[0]

    def pull_many(self, spec: object, eids: list) -> list[dict]:
        return assemble(self._documents, self._referring, [literal(e) for e in eids], spec)

    def entity_tx(self, eid: object) -> dict | None:
        rows = [r for r in (self.node.versions_of(eid, self.basis) if self.node else []) if self.basis.valid_time is None or r["valid_time"] <= self.basis.valid_time]
        best = max(rows, key=lambda r: (r["valid_time"], r["tx_id"]), default=None)
        return best if best and best["content_hash"] is not None else None

    def entity_history(self, eid: object, order: str = "asc", start: dict | None = None, end: dict | None = None, with_corrections: bool = False, with_docs: bool = False) -> list[dict]:
        """Versions in valid-time order up to the basis; start bounds inclusive, end bounds exclusive: {"valid_time", "tx_time", "tx_id"}."""
        if self.node is None:
            raise ValueError("history needs a node or stored tables (tidemark.stored)")
        down = order == "desc"
        rows = self.node.versions_of(eid, self.basis)
        if self.basis.valid_time is not None:
            rows = [r for r in rows if r["valid_time"] <= self.basis.valid_time]
        for bound, first in ((start, True), (end, False)):
            for k, v in (bound or {}).items():
                if first:
                    rows = [r for r in rows if (r[k] <= v if down else r[k] >= v)]
                else:
                    rows = [r for r in rows if (r[k] > v if down else r[k] < v)]
        rows.sort(key=lambda r: (r["valid_time"], r["tx_id"]), reverse=down)
        if not with_corrections:
            best: dict = {}
            for r in rows:
                if r["valid_time"] not in best or r["tx_id"] > best[r["valid_time"]]["tx_id"]:
                    best[r["valid_time"]] = r
            rows = list(best.values())
        if with_docs:
            docs = self.node.documents_at([r["content_hash"] for r in rows if r["content_hash"] is not None])
            rows = [{**r, "doc": docs.get(r["content_hash"])} for r in rows]
        return rows

    def with_tx(self, ops: object) -> Db | None:
        """This database with the operations applied on the side; None if they would abort."""
        if hasattr(self.node, "speculate"):
            return self.node.speculate(self.basis, ops)
        fork = self.node.fork(self.basis)
        tx = fork.submit_tx(ops)
        return fork.db(valid_time=max(filter(None, (self.basis.valid_time, tx["tx_time"])), default=None)) if fork.tx_committed(tx) else None

    def attribute_stats(self) -> dict[str, int]:
        """Number of rows that have each attribute."""
        out: dict[str, int] = {}
        for table in self.catalog.tables.values():
            if not table.attributes:
                continue
            row = table.df.agg(*[F.sum(table.present(a).cast("long")).alias(str(k)) for k, a in enumerate(table.attributes)]).first()
            for k, a in enumerate(table.attributes):
                out[a] = out.get(a, 0) + (row[k] or 0)
        return out


def _plain(v: object) -> object:
    from tidemark.edn import Keyword

    if isinstance(v, Keyword):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, (set, frozenset)):
        return sorted((_plain(x) for x in v), key=str)
    return v


def _value(v: object) -> object:
    """A row's value as a hashable Python one."""
    if isinstance(v, Row):
        return tuple(_value(x) for x in v)
    if isinstance(v, list):
        return tuple(_value(x) for x in v)
    if isinstance(v, Decimal):
        return v.normalize() + 0
    if isinstance(v, datetime):
        return v
    return v
