import hashlib
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.db import Db
from tidemark.model import Catalog, entity_table
from tidemark.node import Node
from tidemark.operators.pull import pull_columns
from tidemark.operators.temporal import fold_put
from tidemark.operators.text import parse_text
from tidemark.plans.sparql import translate
from tidemark.queries import REGISTERED
from tidemark.sources.connect import as_text, log_to_records, records_to_ops
from tidemark.sources.ntriples import documents, parse_ntriples
from tidemark.sources.stores import TableStore, latest_by_key
from tidemark.sql import Sql, split_prefixes
from tidemark.streaming.ingest import LOG, LogIngest, fold_log


@pytest.fixture(scope="module")
def node(spark):
    node = Node(spark)
    node.submit_tx([("put", {"_id": ":ivan", "name": "Ivan", "homeworld": "Earth", "age": 21, "alive": True, "likes": [":bob", ":eve"]}), ("put", {"_id": ":bob", "name": "Malcolm", "homeworld": "Shadow", "age": 40, "alive": False, "likes": [":ivan"]}), ("put", {"_id": ":eve", "name": "Eve%", "homeworld": "Shadow", "age": -7, "alive": True})])
    return node


@pytest.fixture(scope="module")
def sql(spark, node):
    out = Sql(spark, node.db)
    out.create_table("person", "{:find [?id ?name ?homeworld ?age ?alive] :where [[?id :name ?name] [?id :homeworld ?homeworld] [?id :age ?age] [?id :alive ?alive]]}", {"?id": "keyword", "?name": "varchar", "?homeworld": "varchar", "?age": "bigint", "?alive": "boolean"})
    out.create_table("planet", "{:find [?hw] :where [[_ :homeworld ?hw]]}", {"?hw": "varchar"})
    return out


SQL_CASES = [
    ("SELECT name FROM person WHERE age > 20 ORDER BY name", None, [("Ivan",), ("Malcolm",)]),
    ("SELECT name FROM person WHERE name LIKE 'M%'", None, [("Malcolm",)]),
    ("SELECT name FROM person WHERE alive AND age BETWEEN 0 AND 30", None, [("Ivan",)]),
    ("SELECT homeworld, count(*), max(age) FROM person GROUP BY homeworld HAVING count(*) > 1", None, [("Shadow", 2, 40)]),
    ("SELECT p.name FROM person p JOIN planet q ON p.homeworld = q.hw WHERE q.hw = 'Earth'", None, [("Ivan",)]),
    ("SELECT q.hw, p.name FROM planet q LEFT OUTER JOIN person p ON p.homeworld = q.hw AND p.age < 0 ORDER BY 1", None, [("Earth", None), ("Shadow", "Eve%")]),
    ("SELECT name FROM person WHERE id = KEYWORD('bob')", None, [("Malcolm",)]),
    ("SELECT name FROM person WHERE age = ? OR name = ? ORDER BY age", [21, "Malcolm"], [("Ivan",), ("Malcolm",)]),
    ("SELECT {fn CONCAT(name, '!')}, CHAR_LENGTH(name), TRUNCATE(CAST(12.345 AS DOUBLE), 1) FROM person WHERE age = 21 -- a comment", None, [("Ivan!", 4, 12.3)]),
    ("SELECT UPPER(name), INITCAP(LOWER(name)), SUBSTRING(name FROM 2 FOR 2), REPLACE(name, 'I', 'x'), TRIM(BOTH 'n' FROM name) FROM person WHERE age = 21", None, [("IVAN", "Ivan", "va", "xvan", "Iva")]),
    ("SELECT CEIL(1.2), FLOOR(1.8), MOD(7, 3), 21 div 2", None, [(2, 1, 1, 10)]),
    ("VALIDTIME('2001') SELECT count(*) FROM person", None, [(0,)]),
    ("SELECT UUID('AB') AS u", None, [("ab",)]),
    ("SELECT name FROM person ORDER BY age DESC LIMIT 1 OFFSET 1", None, [("Ivan",)]),
]


@pytest.mark.parametrize(("statement", "args", "want"), SQL_CASES, ids=[c[0][:60] for c in SQL_CASES])
def test_sql(sql, statement, args, want):
    assert [tuple(r) for r in sql.sql(statement, args).collect()] == want


def test_sql_bases_and_errors(spark, sql):
    basis, rest = split_prefixes("VALIDTIME('2016-12-01T10') TRANSACTIONTIME('2017') TRANSACTIONID(3) SELECT 1")
    assert basis == {"valid_time": datetime(2016, 12, 1, 10), "tx_time": datetime(2017, 1, 1), "tx_id": 3} and rest.strip() == "SELECT 1"
    with pytest.raises(ValueError, match="unknown type"):
        sql.create_table("bad", "{:find [x] :in [x]}", {"x": "time"})
    assert "Plan" in str(sql.sql("EXPLAIN PLAN FOR SELECT name FROM person").collect())


PULLS = [
    ("[:name]", {"name": "Ivan"}),
    ("[]", {}),
    ("[(:name {:as :n}) (:nope {:default 3})]", {"n": "Ivan", "nope": 3}),
    ("[{:likes [:name]}]", {"likes": [{"name": "Malcolm"}, {"name": "Eve%"}]}),
    ("[(:likes {:limit 1})]", {"likes": [":bob"]}),
    ("[{:_likes [:name]}]", {"_likes": [{"name": "Malcolm"}]}),
    ("[{(:_likes {:cardinality :one}) [:name]}]", {"_likes": {"name": "Malcolm"}}),
    ("[:name {:likes ...}]", {"name": "Ivan", "likes": [{"name": "Malcolm"}, {"name": "Eve%"}]}),
    ("[:name {:likes 1}]", {"name": "Ivan", "likes": [{"name": "Malcolm"}, {"name": "Eve%"}]}),
    ("[{:homeworld {\"Earth\" [:name] \"Shadow\" [:age]}}]", {"name": "Ivan"}),
]


@pytest.mark.parametrize(("spec", "want"), PULLS, ids=[p[0] for p in PULLS])
def test_pull(node, spec, want):
    got = node.db().pull(spec, ":ivan")
    if "likes" in want and isinstance(want["likes"], list) and want["likes"] and isinstance(want["likes"][0], dict):
        assert sorted(map(str, got.pop("likes"))) == sorted(map(str, want["likes"]))
        want = {k: v for k, v in want.items() if k != "likes"}
    assert got == want


def test_pull_everything_and_nothing(node):
    assert node.db().pull("[*]", ":eve")["name"] == "Eve%" and node.db().pull("[:name]", ":nobody") == {}
    assert node.db().pull_many("[:age]", [":eve", ":bob"]) == [{"age": -7}, {"age": 40}]


def test_pull_columns(spark):
    people = spark.createDataFrame([(1, "a", 2, [2, 3]), (2, "b", None, None), (3, "c", 2, [])], "id long, name string, boss long, friends array<long>")
    catalog = Catalog().add(entity_table("people", people, "id"))
    ids = spark.createDataFrame([(1,), (2,), (9,)], "eid long")
    got = {r["eid"]: r["pulled"].asDict(recursive=True) for r in pull_columns(catalog, ids, "[:name {:boss [:name]} {:friends [:name]} {:_boss [:name]} (:none0 {:default 5})]".replace("(:none0 {:default 5})", "")).collect()}
    assert got[1] == {"name": "a", "boss": {"name": "b"}, "friends": [{"name": "b"}, {"name": "c"}], "_boss": None}
    assert sorted(x["name"] for x in got[2]["_boss"]) == ["a", "c"] and got[9]["name"] is None
    db = Db(spark, catalog)
    assert db.entity(2) == {"_id": 2, "name": "b", "id": 2}


def test_text_grammar():
    assert parse_text("a b")[0] == "or" and parse_text("a AND NOT b")[0] == "and" and parse_text("f:x")[1][0].field == "f"


SPARQL_CASES = [
    ('SELECT ?e WHERE { ?e <name> "Ivan" }', {(":ivan",)}),
    ("SELECT ?n WHERE { ?e <name> ?n ; <age> ?a . FILTER(?a > 0 && ?a < 30) }", {("Ivan",)}),
    ('SELECT ?n WHERE { ?e <name> ?n . FILTER regex(?n, "^m", "i") }', {("Malcolm",)}),
    ('SELECT ?n WHERE { ?e <name> ?n . FILTER(?n IN ("Ivan", "Nobody")) }', {("Ivan",)}),
    ("SELECT ?n WHERE { ?e <name> ?n . FILTER NOT EXISTS { ?e <likes> ?x } }", {("Eve%",)}),
    ("SELECT ?n WHERE { ?e <name> ?n . ?e <age> ?a . BIND(?a * 2 AS ?b) FILTER(?b = 80) }", {("Malcolm",)}),
    ('SELECT ?a ?n WHERE { ?e <age> ?a . ?e <name> ?n . VALUES ?n { "Ivan" "Malcolm" } }', {(21, "Ivan"), (40, "Malcolm")}),
    ("SELECT ?n WHERE { ?e <name> ?n . ?e <age> ?a } ORDER BY ?n LIMIT 1 OFFSET 1", [("Ivan",)]),
    ("PREFIX p: <na> SELECT ?n WHERE { ?e p:me ?n . { ?e <age> 21 } UNION { ?e <age> 40 } }", {("Ivan",), ("Malcolm",)}),
    ("SELECT ?b WHERE { ?a <likes>+ ?b . ?a <name> \"Ivan\" }", {(":bob",), (":eve",), (":ivan",)}),
]


@pytest.mark.parametrize(("text", "want"), SPARQL_CASES, ids=[c[0][:60] for c in SPARQL_CASES])
def test_sparql(node, text, want):
    query, args = translate(text)
    assert node.db().q(query, *args) == want


def test_sparql_refuses():
    for text in ("SELECT ?p WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s <a> ?o MINUS { ?s <b> ?o } }"):
        with pytest.raises(ValueError, match="not supported"):
            translate(text)


def test_ntriples(spark):
    lines = spark.createDataFrame([('<http://x/a> <http://x/name> "A \\"q\\""@en .',), ("<http://x/a> <http://x/knows> <http://x/b> . # note",), ("# only a comment",), ('_:n <http://x/age> "4"^^<http://www.w3.org/2001/XMLSchema#integer> .',), ("broken",)], "value string")
    facts = parse_ntriples(lines)
    assert {(r["s"], r["o"], r["kind"], r["lang"]) for r in facts.collect()} == {("http://x/a", 'A "q"', "string", "en"), ("http://x/a", "http://x/b", "iri", None), ("_:n", "4", "integer", None)}
    docs = {r["eid"]: r for r in documents(facts, ["http://x/name", "http://x/knows"]).collect()}
    assert docs["http://x/a"]["http://x/knows"] == ["http://x/b"]


def test_connect_and_formats(spark):
    records = spark.createDataFrame([("k1", '{"_id": "d1", "v": 1}'), ("k2", None), ("k3", '{"v": 2}')], "key string, value string")
    assert sorted((r["op"], r["eid"]) for r in records_to_ops(records).collect()) == [("delete", "k2"), ("put", "d1"), ("put", "k3")]
    log = spark.createDataFrame([(1, datetime(2020, 1, 1), 0, "put", "a", None, None, "{}")], LOG)
    assert log_to_records(log).first()["key"] == "1" and log_to_records(log, "doc").count() == 1
    rows = spark.createDataFrame([(1, 'a,"b'), (2, None)], "n long, s string")
    assert [r["value"] for r in as_text(rows, "csv").collect()] == ["n,s", '1,"a,""b"', "2,"]
    assert [r["value"] for r in as_text(rows, "edn").collect()] == ['[1 "a,\\"b"]', "[2 nil]"]
    compacted = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "key string, offset long, value string")
    assert [tuple(r) for r in latest_by_key(compacted).select("key", "value").collect()] == [("a", "y")]


def test_stream_of_a_log_equals_the_node(spark, tmp_path):
    day = lambda k: datetime(2020, 1, k)
    rows = [(0, day(1), 0, "put", "x", day(1), None, "one"), (1, day(2), 0, "put", "x", day(5), day(9), "two"), (1, day(2), 1, "put", "y", None, None, "why"), (2, day(3), 0, "delete", "x", day(7), None, None), (3, day(4), 0, "put", "z", day(2), None, "zed"), (4, day(5), 0, "evict", "z", None, None, None)]
    node = Node(spark)
    for tx in range(5):
        node.submit_tx([("put", {"_id": r[4], "v": r[7]}, r[5], r[6]) if r[3] == "put" else (r[3], r[4], r[5]) if r[3] == "delete" else ("evict", r[4]) for r in rows if r[0] == tx], tx_time=rows[[r[0] for r in rows].index(tx)][1])
    folder, seen = f"file://{tmp_path}", []
    ingest = LogIngest(spark, f"{folder}/t", [seen.append])
    for part in ([r for r in rows if r[0] < 2], [r for r in rows if r[0] >= 2]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        ingest.start(f"{folder}/log", available_now=True).awaitTermination()
    assert ingest.latest_tx() == 4 and [e["tx_id"] for e in seen] == [1, 4]
    for k in (1, 3, 5, 6, 8, 10):
        want = {(r[0], r[1]) for r in node.db(valid_time=day(k)).q("{:find [e v] :where [[e :v v]]}")}
        assert {(r["eid"], r["doc"]) for r in ingest.current(day(k)).collect()} == want
    again = LogIngest(spark, f"{folder}/t")
    again.batch(spark.createDataFrame(rows[:1], LOG), 0)
    assert again.versions().count() == ingest.versions().count()
    before = sorted(map(str, ingest.versions().collect()))
    ingest.compact()
    ingest.compact()
    assert sorted(map(str, ingest.versions().collect())) == before
    ingest.batch(spark.createDataFrame([(9, day(9), 0, "put", "x", day(20), None, "later")], LOG), 9)
    assert {(r["eid"], r["doc"]) for r in ingest.current(day(21)).collect()} == {("x", "later"), ("y", "why")}


def test_fold_in_one_batch_equals_two(spark):
    day = lambda k: datetime(2020, 1, k)
    rows = [(k, day(k + 1), 0, "put" if k % 4 else "delete", f"e{k % 3}", day((k * 7) % 11 + 1), day((k * 7) % 11 + 4) if k % 2 else None, f"d{k}") for k in range(20)]
    log = spark.createDataFrame(rows, LOG)
    whole = fold_log(log)
    halves = fold_log(log.where("tx_id >= 10"), fold_log(log.where("tx_id < 10")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, halves.select(whole.columns).collect()))


def test_table_store_shows_whole_generations_only(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.last_order() is None
    store.write(spark.range(3), 1)
    store.write(spark.range(5), 1)
    store.write(spark.range(2), 2)
    assert store.read().count() == 5 and store.read(1).count() == 3 and store.last_order() == 2
    spark.range(9).write.parquet(f"file://{tmp_path}/s/{3:020d}-add-left-by-a-lost-writer")
    assert store.read().count() == 5
    store.write(spark.range(4), 2, base=True)
    store.write(spark.range(1), 3)
    store.prune()
    assert store.read().count() == 5 and store.read(2).count() == 4


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = REGISTERED["filter_agg"][0](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert plan.count("Scan parquet") == 2  # named in the tree and in its details: one scan


def test_open_q_streams(node):
    assert sorted(n for (n,) in node.db().open_q("{:find [n] :where [[_ :name n]]}")) == ["Eve%", "Ivan", "Malcolm"]


def test_registered_queries_run(spark, sf):
    began = time.time()
    for name, (fn, _) in REGISTERED.items():
        assert fn(spark, sf).columns, name
    assert time.time() - began < 300


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert F is not None


def test_all_suppliers_that_share_the_largest_revenue(spark, tmp_path):
    """Equal in decimals, though doubles summed in these orders differ."""
    prices = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.2, 0.2, 0.1]}
    lines = [(s, p, 0.0, datetime(1998, 2, 1)) for s, ps in prices.items() for p in ps]
    spark.createDataFrame(lines, "l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, f"S{s}") for s in prices], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(tuple, REGISTERED["subq_max"][0](spark, str(tmp_path)).collect())) == [(1, "S1", 0.6), (2, "S2", 0.6)]


def test_entities_are_folded_in_a_stream(spark):
    """Many entities in one batch, and one whose rows fill several: as the same operations one by one."""
    when = datetime(2024, 3, 1)
    rows = [(tx, when, 0, "put", f"e{k}", datetime(2024, 2, 1 + tx % 5), datetime(2024, 2, 2 + tx % 5 + k % 3) if tx % 2 else None, f"d{tx}") for k in range(40) for tx in range(3)]
    rows += [(tx, when, 0, "put" if tx % 3 else "delete", "long", datetime(2024, 2, 1 + tx % 9), datetime(2024, 2, 11), f"d{tx}") for tx in range(30)]
    log, apart = spark.createDataFrame(rows, LOG), {}
    versions = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    for size in (7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        folded = fold_log(log)
        apart[size] = versions(folded)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert apart[7] == apart[10000] and "MapInArrow" in plan and "FlatMapGroups" not in plan
    for eid in ("e1", "e2", "long"):
        existing = []
        for tx, tt, _, op, _, vt, end, doc in (r for r in rows if r[4] == eid):
            for row in fold_put(existing, vt, end, tt, tx, hashlib.sha1(doc.encode()).hexdigest() if op == "put" else None):
                existing = [v for v in existing if (v[0], v[2]) != (row[0], row[2])] + [row]
        key = lambda r: tuple(map(str, r))
        assert sorted(((eid, *v) for v in existing), key=key) == sorted((r for r in apart[7] if r[0] == eid), key=key)
