import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from tidemark.node import Node, OutOfSync
from tidemark.stored import StoredNode, merge, plain
from tidemark.streaming.ingest import LOG

DAY = [datetime(2020, 1, 1) + timedelta(days=k) for k in range(40)]

OPS = [
    [("put", {"_id": "x", "v": 1, "tags": ["a", "b"], "boss": "y"}, DAY[1])],
    [("put", {"_id": "y", "v": 2.5, "name": "why"}, DAY[0])],
    [("put", {"_id": "x", "v": 7, "boss": "y"}, DAY[5], DAY[9])],
    [("put", {"_id": "z", "v": 9}, DAY[2]), ("put", {"_id": "z", "v": 9}, DAY[6])],
    [("put", {"_id": "z", "v": 10}, DAY[3])],
    [("delete", "y", DAY[20])],
]


def log_rows(ops, first=0):
    rows = []
    for tx, some in enumerate(ops, first):
        for k, (kind, what, *times) in enumerate(some):
            start, end = [*times, None, None][:2]
            rows.append((tx, DAY[30] + timedelta(hours=tx), k, kind, what["_id"] if isinstance(what, dict) else what, start, end, json.dumps(what) if isinstance(what, dict) else None))
    return rows


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same transactions in a node and, in two batches, in stored tables."""
    node = Node(spark)
    for tx, ops in enumerate(OPS):
        node.submit_tx(ops, DAY[30] + timedelta(hours=tx))
    stored = StoredNode(spark, f"file://{tmp_path_factory.mktemp('stored')}")
    stored.submit(spark.createDataFrame(log_rows(OPS[:3]), LOG))
    stored.submit(spark.createDataFrame(log_rows(OPS[3:], 3), LOG))
    return node, stored


def test_same_answers_at_every_basis(both):
    node, stored = both
    for day, tx in ((0, 1), (4, 5), (6, 2), (6, 3), (25, 4), (25, 5)):
        a, b = node.db(valid_time=DAY[day], tx_id=tx), stored.db(valid_time=DAY[day], tx_id=tx)
        for query in ("{:find [e v] :where [[e :v v] [(> v 1)]]}", "{:find [e t] :where [[e :tags t]]}", "{:find [e n] :where [[e :boss b] [b :name n]]}", "{:find [(sum v)] :where [[e :v v]]}"):
            assert b.q(query) == a.q(query), (day, tx, query)


def test_history_entities_and_pull(both):
    node, stored = both
    a, b = node.db(valid_time=DAY[25]), stored.db(valid_time=DAY[25])
    for eid in ("x", "y", "z"):
        for order in ("asc", "desc"):
            strip = lambda rows: [(r["valid_time"], r["tx_id"], (r["doc"] or {}).get("v")) for r in rows]
            assert strip(b.entity_history(eid, order, with_docs=True)) == strip(a.entity_history(eid, order, with_docs=True))
    assert b.entity("x") == {"_id": "x", "v": 1, "tags": ("a", "b"), "boss": "y"} and b.entity("y") is None
    assert stored.db(valid_time=DAY[8]).pull("[:v {:boss [:name]}]", "x") == {"v": 7, "boss": {"name": "why"}}
    assert b.entity_tx("z")["tx_id"] == a.entity_tx("z")["tx_id"] and b.entity_tx("y") is None
    assert b.attribute_stats()["v"] == 2 and stored.status()["entities"] == 3


def test_basis_log_and_speculation(both):
    _, stored = both
    with pytest.raises(OutOfSync):
        stored.db(tx_id=99)
    assert stored.db(DAY[10], tx_time=DAY[30] + timedelta(hours=1, minutes=1)).basis.tx_id == 1
    assert [r["tx_id"] for r in stored.open_tx_log(2).collect()] == [3, 4, 5]
    db = stored.db(valid_time=DAY[25])
    side = db.with_tx([("put", {"_id": "new", "v": 4}), ("delete", "x")])
    values = "{:find [e v] :where [[e :v v]]}"
    assert side.q(values) == {("new", 4), ("z", 10)} and db.q(values) == {("x", 1), ("z", 10)}
    assert stored.recent_queries()


def test_eviction_and_compaction(spark, tmp_path):
    stored = StoredNode(spark, f"file://{tmp_path}")
    stored.submit(spark.createDataFrame(log_rows(OPS), LOG))
    stored.submit(spark.createDataFrame([(9, DAY[32], 0, "evict", "x", None, None, None)], LOG))
    values = "{:find [e v] :where [[e :v v]]}"
    before = stored.db(valid_time=DAY[10]).q(values)
    assert before == {("y", 2.5), ("z", 10)}
    stored.ingest.compact()
    assert stored.db(valid_time=DAY[10]).q(values) == before and stored.db(valid_time=DAY[10]).entity_history("x") == []


def test_empty_tables_and_declared_types(spark, tmp_path):
    empty = StoredNode(spark, f"file://{tmp_path}/none")
    assert empty.latest_completed_tx() is None and empty.db().q("{:find [e v] :where [[e :v v]]}") == set()
    stored = StoredNode(spark, f"file://{tmp_path}/typed", types={"at": "timestamp"})
    stored.submit(spark.createDataFrame([(0, DAY[0], 0, "put", "t", None, None, '{"_id": "t", "at": "2020-01-03T00:00:00Z"}')], LOG))
    assert stored.db().q('{:find [e] :where [[e :at t] [(> t #inst "2020-01-02")]]}') == {("t",)}


def test_types_merge():
    assert merge(T.LongType(), T.DoubleType()) == T.DoubleType() and merge(T.LongType(), T.StringType()) == T.StringType()
    assert merge(T.ArrayType(T.NullType()), T.ArrayType(T.LongType())) == T.ArrayType(T.LongType())
    assert plain(T.DecimalType(3, 1)) == T.DoubleType() and plain(T.DecimalType(5, 0)) == T.LongType() and plain(T.NullType()) == T.StringType()
