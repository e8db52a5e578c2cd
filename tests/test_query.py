from datetime import datetime

import pytest

from tidemark.edn import Keyword as K
from tidemark.edn import Symbol, read
from tidemark.node import Node


@pytest.fixture(scope="module")
def db(spark):
    node = Node(spark)
    node.submit_tx("""
      [[:db.tx/put {:db/id :ivan :name "Ivan" :last-name "Ivanov" :age 30 :friends #{:bob :dominic} :boss :bob :born #inst "1990-05-01"}]
       [:db.tx/put {:db/id :bob :name "Bob" :last-name "Bobson" :age 40 :boss :dominic}]
       [:db.tx/put {:db/id :dominic :name "Dominic" :last-name "Monroe" :age 50 :tags [1 1 2]}]
       [:db.tx/put {:db/id :petr :name "Petr" :last-name "Ivanov" :age 30 :note nil}]]""")
    return node.db()


CASES = [
    ('{:find [e] :where [[e :name "Ivan"]]}', (), {(":ivan",)}),
    ('{:find [e] :where [[e :name "nobody"]]}', (), set()),
    ("{:find [n] :where [[:bob :name n]]}", (), {("Bob",)}),
    ("{:find [n] :where [[nil :name n]]}", (), set()),
    ('{:find [e] :where [[:ivan :name "Nobody"] [e :age 50]]}', (), set()),
    ('{:find [e] :where [[:ivan :name "Ivan"] [e :age 50]]}', (), {(":dominic",)}),
    ('{:find [x] :in [x] :where [[:ivan :name "Nobody"]]}', (1,), set()),
    ("{:find [x] :where [[(identity 3) x] [(q {:find [e] :where [[e :age 99]]})]]}", (), set()),
    ('{:find [e] :where [[:ivan :no-such-attribute "x"] [e :age 50]]}', (), set()),
    ("{:find [a] :where [[(= 1 2)] (above a b)] :rules [[(above a b) [b :boss a]]]}", (), set()),
    ("{:find [x] :where [[(identity 3) x] (not [:ivan :age 30])]}", (), set()),
    ("{:find [e] :where [[#{:bob :ivan} :name n] [e :name n]]}", (), {(":bob",), (":ivan",)}),
    ('{:find [e] :where [[e :name #{"Bob" "Petr"}]]}', (), {(":bob",), (":petr",)}),
    ("{:find [e] :where [[e :name #{}]]}", (), set()),
    ("{:find [n] :where [[e :friends f] [f :name n]]}", (), {("Bob",), ("Dominic",)}),
    ("{:find [(count t)] :where [[e :tags t]]}", (), {(2,)}),
    ("{:find [e] :where [[e :note]]}", (), {(":petr",)}),
    ("{:find [e] :where [[e :note nil]]}", (), {(":petr",)}),
    ("{:find [a b] :where [[a :last-name l] [b :last-name l] [(!= a b)]]}", (), {(":ivan", ":petr"), (":petr", ":ivan")}),
    ("{:find [e] :where [[e :age a] [(<= 40 a)] [(< a 50)]]}", (), {(":bob",)}),
    ('{:find [e] :where [[e :age a] [(< a "x")]]}', (), set()),
    ("{:find [a b] :where [[a :age x] [b :age y] [(< x y)] [b :name \"Bob\"]]}", (), {(":ivan", ":bob"), (":petr", ":bob")}),
    ("{:find [e m] :where [[e :age a] [(mod a 20) m] [(odd? 3)]]}", (), {(":ivan", 10), (":bob", 0), (":dominic", 10), (":petr", 10)}),
    ("{:find [e] :where [[e :age a] [(/ a 2) h] [(identity 15.0) h]]}", (), {(":ivan",), (":petr",)}),
    ('{:find [e] :where [[e :name n] [(re-find "^I" n)]]}', (), {(":ivan",)}),
    ('{:find [s] :where [[e :name n] [(subs n 0 2) s] [(str s "!") t] [(= t "Iv!")]]}', (), {("Iv",)}),
    ("{:find [x] :where [[(vector 1 2 2) [x ...]]]}", (), {(1,), (2,)}),
    ("{:find [a b] :where [[(vector 1 2) [a b]]]}", (), {(1, 2)}),
    ("{:find [e] :where [[e :name] (not [e :last-name \"Ivanov\"])]}", (), {(":bob",), (":dominic",)}),
    ("{:find [e] :where [[e :name] (not-join [e] [x :boss e])]}", (), {(":ivan",), (":petr",)}),
    ("{:find [e] :where [[e :age a] (not [(= a 30)])]}", (), {(":bob",), (":dominic",)}),
    ("{:find [e] :where [(or [e :name \"Bob\"] (and [e :last-name \"Ivanov\"] [e :boss]))]}", (), {(":bob",), (":ivan",)}),
    ("{:find [e] :where [[e :age a] (or [(= a 50)] [(< a 35)])]}", (), {(":ivan",), (":petr",), (":dominic",)}),
    ("{:find [e] :where [[e :name] (or-join [e] (and [x :boss e] [x :age 30]))]}", (), {(":bob",)}),
    ("{:find [e] :where [(or [e :name \"Bob\"] (and [e :name] (not [e :boss])))]}", (), {(":bob",), (":dominic",), (":petr",)}),
    ("{:find [e] :in [n] :where [[e :name n]]}", ("Bob",), {(":bob",)}),
    ("{:find [e] :in [[n l]] :where [[e :name n] [e :last-name l]]}", (("Ivan", "Ivanov"),), {(":ivan",)}),
    ("{:find [e] :in [[n ...]] :where [[e :name n]]}", (["Bob", "Petr"],), {(":bob",), (":petr",)}),
    ("{:find [e x] :in [[[n x]]] :where [[e :name n]]}", ([("Bob", 1), ("Petr", 2)],), {(":bob", 1), (":petr", 2)}),
    ("{:find [x] :in [[x ...]]}", ([3, 3, 4],), {(3,), (4,)}),
    ('{:find [e] :where [[e :name n]] :args [{n "Bob"} {n "Ivan"}]}', (), {(":bob",), (":ivan",)}),
    ("{:find [e b] :where [[e :name] [(get-attr e :boss :none) [b ...]]]}", (), {(":ivan", ":bob"), (":bob", ":dominic"), (":dominic", ":none"), (":petr", ":none")}),
    ("{:find [e] :where [[e :name] [(get-attr e :boss)]]}", (), {(":ivan",), (":bob",)}),
    ("{:find [e] :where [[e :friends f] [(== f #{:bob})]]}", (), {(":ivan",)}),
    ("{:find [e] :where [[e :age a] [(q {:find [(max x)] :where [[_ :age x]]}) [[a]]]]}", (), {(":dominic",)}),
    ("{:find [e] :where [[e :name] [(q {:find [x] :in [e] :where [[x :boss e]]} e)]]}", (), {(":bob",), (":dominic",)}),
    ("{:find [e n] :where [[e :name] [(q {:find [(count x)] :in [e] :where [[x :boss e]]} e) [[n]]]]}", (), {(":bob", 1), (":dominic", 1)}),
    ("{:find [l (sum a) (count e)] :where [[e :last-name l] [e :age a]]}", (), {("Ivanov", 60, 2), ("Bobson", 40, 1), ("Monroe", 50, 1)}),
    ("{:find [(sum a)] :where [[e :age a] [(> a 99)]]}", (), set()),
    ("{:find [(min 2 a) (max 2 a) (median a) (variance a) (count-distinct a)] :where [[e :age a]]}", (), {((30, 40), (40, 50), 35.0, 68.75, 3)}),
    ("{:find [n a] :where [[e :name n] [e :age a]] :order-by [[a :desc] [n :asc]] :limit 2 :offset 1}", (), [("Bob", 40), ("Ivan", 30)]),
    ("{:find [a] :where [[e :age a]] :order-by [[a :asc]]}", (), [(30,), (30,), (40,), (50,)]),
    ("{:find [n a] :keys [nm ag] :where [[e :name n] [e :age a] [(= a 50)]]}", (), [{"nm": "Dominic", "ag": 50}]),
    ("[:find n :where [e :name n] [e :age 40]]", (), {("Bob",)}),
    ("{:find [e] :where [[e :born b] [(< b #inst \"1991\")]]}", (), {(":ivan",)}),
    ("{:find [(pull e [:name {:boss [:name]}])] :where [[e :name \"Ivan\"]]}", (), [({"name": "Ivan", "boss": {"name": "Bob"}},)]),
    ("{:find [a b] :where [(above a b)] :rules [[(above a b) [b :boss a]] [(above a b) [b :boss x] (above a x)]]}", (), {(":bob", ":ivan"), (":dominic", ":bob"), (":dominic", ":ivan")}),
    ("{:find [b] :where [(above :dominic b)] :rules [[(above a b) [b :boss a]] [(above a b) (above a x) (above x b)]]}", (), {(":bob",), (":ivan",)}),
    ("{:find [e] :where [[e :name] (old e 35)] :rules [[(old e n) [e :age a] [(> a n)]]]}", (), {(":bob",), (":dominic",)}),
    ("{:find [f] :in [n] :where [(fib n f)] :rules [[(fib [n] f) [(<= n 1)] [(identity n) f]] [(fib [n] f) [(> n 1)] [(- n 1) a] [(- n 2) b] (fib a x) (fib b y) [(+ x y) f]]]}", (6,), {(8,)}),
    ('{:find [e v] :where [[(text-search :last-name "ivan*") [[e v s]]]]}', (), {(":ivan", "Ivanov"), (":petr", "Ivanov")}),
    ('{:find [e a] :where [[(wildcard-text-search "bob OR monroe") [[e v a s]]]]}', (), {(":bob", "name"), (":dominic", "last-name")}),
    ('{:find [e] :where [[(multi-text-search "name:%s AND last-name:%s" "ivan" "ivanov") [[e s]]]]}', (), {(":ivan",)}),
]


@pytest.mark.parametrize(("query", "args", "want"), CASES, ids=[c[0][:70] for c in CASES])
def test_query(db, query, args, want):
    assert db.q(query, *args) == want


ERRORS = [
    "{:find [x] :where [[e :name n]]}",
    "{:find [e] :where [[e a n]]}",
    "{:find [e] :where [[e :name [1 2]]]}",
    "{:find [e] :in [x x] :where [[e :name x]]}",
    "{:find [e] :where [[e :name n]] :order-by [[n :asc]]}",
    "{:find [e] :keys [a b] :where [[e :name]]}",
    "{:find [e] :where [(or [e :name n] [e :age])]}",
    "{:find [e] :where [(or-join [e n] [e :name] [e :name n])]}",
    "{:find [e] :where [[e :name n] [(cycle n) x]]}",
    "{:find [e] :where [[e :name n] [(no-such-function n)]]}",
    "{:find [e] :where [(nope e)]}",
    "{:find [e] :full-results? true :where [[e :name]]}",
    "{:find [(sample e)] :where [[e :name]]}",
    "{:find [e] :where [[e :name] (p e)] :rules [[(p e) [e :age a] (not (p e))]]}",
    "{:find [e] :where [[(f) [[x x]]]]}",
]


@pytest.mark.parametrize("query", ERRORS)
def test_errors(db, query):
    with pytest.raises(Exception, match="."):
        db.q(query, *([1, 2] if ":in" in query else []))


def test_not_needs_bound_variables(db):
    with pytest.raises(Exception, match="nothing binds"):
        db.q("{:find [e] :where [[e :name] (not [e :boss x])]}")


def test_cyclic_graphs_end(spark):
    node = Node(spark)
    node.submit_tx([("put", {"_id": f"n{k}", "to": f"n{(k + 1) % 4}"}) for k in range(4)])
    rules = ":rules [[(path a b) [a :to b]] [(path a b) [a :to x] (path x b)]]"
    assert len(node.db().q(f"{{:find [a b] :where [(path a b)] {rules}}}")) == 16


def test_mutual_recursion_and_stratified_negation(spark):
    node = Node(spark)
    node.submit_tx([("put", {"_id": k, "next": k + 1}) for k in range(5)])
    rules = ":rules [[(even a b) [a :next x] (odd x b)] [(odd a b) [a :next b]] [(odd a b) [a :next x] (even x b)] [(lone a b) [a :next] [b :next] (not (odd a b)) (not (even a b))]]"
    assert node.db().q(f"{{:find [b] :where [(even 0 b)] {rules}}}") == {(2,), (4,)}
    assert (4, 0) in node.db().q(f"{{:find [a b] :where [(lone a b)] {rules}}}")


def test_only_rules_that_compute_values_are_bounded_in_rounds(spark, monkeypatch):
    from tidemark.plans import rules
    from tidemark.plans.sparql import translate

    monkeypatch.setattr(rules, "MOST_ROUNDS", 3)
    node = Node(spark)
    node.submit_tx([("put", {"_id": k, "to": k + 1}) for k in range(20)])
    query, args = translate("SELECT ?b WHERE { 0 <to>+ ?b }")
    assert node.db().q(query, *args) == {(k + 1,) for k in range(20)}
    chain = ":rules [[(path a b) [a :to b]] [(path a b) [a :to x] (path x b)]]"
    assert len(node.db().q(f"{{:find [a b] :where [(path a b)] {chain}}}")) == 210
    counting = ":rules [[(up a b) [a :to b]] [(up a b) (up a x) [(+ x 1) b] [(< b 30)]]]"
    with pytest.raises(ValueError, match="most-rounds"):
        node.db().q(f"{{:find [b] :where [(up 0 b)] {counting}}}")
    assert node.db().q(f"{{:find [b] :where [(up 0 b)] {counting} :most-rounds 40 :timeout 100000}}") == {(k,) for k in range(1, 30)}


def test_functions_as_arguments_and_allow_list(spark):
    from pyspark.sql import functions as F

    node = Node(spark, functions={"mine/double": lambda x: x * 2}, fn_allow_list={"mine"})
    node.submit_tx([("put", {"_id": "a", "n": 4})])
    assert node.db().q("{:find [m] :where [[e :n n] [(mine/double n) m]]}") == {(8,)}
    assert node.db().q("{:find [e] :in [?big] :where [[e :n n] [(?big n)]]}", lambda x: F.col("n") > 3 if x is None else x > 3) == {("a",)}
    with pytest.raises(ValueError, match="allow-list"):
        node.db().q('{:find [e] :where [[e :n n] [(clojure.string/upper-case "x") u]]}')


def test_timeout(spark):
    node = Node(spark)
    node.submit_tx([("put", {"_id": k, "n": k}) for k in range(50)])
    with pytest.raises(TimeoutError):
        node.db().q("{:find [(count a)] :where [[a :n x] [b :n y] [c :n z] [d :n w] [e :n v]] :timeout 200}")


def test_reader():
    form = read('{:a [1 -2.5 3N 1.5M 1/2 nil true \\a "x\\n"] ; comment\n #_skipped :b #{:k/x sym} :c #inst "2020-02" :d (f ?x) :e #uuid "00000000-0000-0000-0000-000000000001"}')
    assert form[K("b")] == frozenset({K("k/x"), Symbol("sym")})
    assert form[K("a")][:3] == [1, -2.5, 3] and form[K("a")][5:] == [None, True, "a", "x\n"]
    assert form[K("c")].replace(tzinfo=None) == datetime(2020, 2, 1)
    for broken in ("[1 2", "{:a}", "[1}"):
        with pytest.raises((ValueError, EOFError)):
            read(broken)


def test_aggregates_that_keep_some_values(spark):
    from tidemark.db import Db
    from tidemark.model import Catalog, entity_table

    rows = [(k, "a" if k % 3 else "b", k % 5 if k % 3 else None) for k in range(300)] + [(300, "c", 9)]
    table = Db(spark, Catalog().add(entity_table("t", spark.createDataFrame(rows, "id long, g string, v long"), "id")))
    found = {r["g"]: r for r in table.df("{:find [g (min 2 v) (max 2 v) (sample 3 v) (rand 7 v) (count v)] :keys [g lo hi some drawn n] :where [[e :g g] [e :v v]]}").collect()}
    assert (found["a"]["lo"], found["a"]["hi"], found["a"]["n"]) == ([0, 1], [3, 4], 200)
    assert len(set(found["a"]["some"])) == 3 and len(found["a"]["drawn"]) == 7 and set(found["a"]["some"] + found["a"]["drawn"]) <= set(range(5))
    assert (found["c"]["lo"], found["c"]["some"], found["c"]["drawn"]) == ([9], [9], [9] * 7)
    assert set(found) == {"a", "c"}
    assert table.q("{:find [(min 2 v)] :where [[e :v v] [e :g \"a\"]]}") == {((0, 1),)}
    assert table.q("{:find [(min 2 v)] :where [[e :v v] [e :g \"none\"]]}") == set()


def test_draws_follow_the_counts_of_values(spark):
    from tidemark.functions.aggregates import some_values

    rows = spark.createDataFrame([("x", 1)] * 900 + [("x", 2)] * 100, "g string, v long")
    drawn = some_values(rows, ["g"], "v", "rand", 400).first()["v"]
    assert len(drawn) == 400 and 300 < drawn.count(1) < 395


def test_a_group_of_nothing_has_no_values_to_give(spark):
    node = Node(spark)
    node.submit_tx('[[:db.tx/put {:db/id :a :kind "x" :v nil}] [:db.tx/put {:db/id :b :kind "y" :v 4}]]')
    assert node.db().q("{:find [k (min 2 v) (rand 2 v)] :where [[e :kind k] [e :v v]]}") == {("x", (), ()), ("y", (4,), (4, 4))}


def test_joins_along_keys_come_before_products(spark, monkeypatch):
    """Customers and suppliers of one nation meet along their orders' lines only."""
    from tidemark.db import Db
    from tidemark.model import Catalog, entity_table
    from tidemark.plans.compile import Compiler

    catalog = Catalog()
    for name, rows, columns in (
        ("customer", [(k, 1) for k in range(20)], "c_id long, c_nation int"),
        ("orders", [(k, k % 20) for k in range(40)], "o_id long, o_customer long"),
        ("line", [(k % 40, k % 20) for k in range(80)], "l_order long, l_supplier long"),
        ("supplier", [(k, 1) for k in range(20)], "s_id long, s_nation int"),
        ("nation", [(1, "here")], "n_id int, n_name string"),
    ):
        catalog.add(entity_table(name, spark.createDataFrame(rows, columns), None if name == "line" else f"{name[0]}_id"))
    made, join = [], Compiler.join

    def counted(self, a, b, how="inner"):
        made.append(join(self, a, b, how))
        return made[-1]

    monkeypatch.setattr(Compiler, "join", counted)
    out = Db(spark, catalog).df('{:find [(count o)] :where [[c :c_nation n] [o :o_customer c] [l :l_order o] [l :l_supplier s] [s :s_nation n] [n :n_name "here"]]}')
    assert out.first()[0] == 80
    assert max(df.count() for df in made) <= 80


def test_rows_of_one_id_are_compared_the_others_are_not(spark, tmp_path):
    from tidemark.db import Db
    from tidemark.model import Catalog, entity_table

    rows = [(1, "a b"), (2, "b c"), (2, "b c"), (2, "c"), (None, "d"), (None, "d"), (3, "b c"), (4, None)]
    spark.createDataFrame(rows, "id long, name string").write.parquet(f"{tmp_path}/t")
    out = Db(spark, Catalog().add(entity_table("t", spark.read.parquet(f"{tmp_path}/t"), "id"))).df('{:find [e w m] :where [[e :name n] [(split n " ") w] [(count n) m]]}')
    want = [(1, ["a", "b"], 3), (2, ["b", "c"], 3), (2, ["c"], 1), (3, ["b", "c"], 3), (None, ["d"], 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # Rows whose id is there once pass no aggregation, only the join that tells so.
    first = out._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[0]
    assert "LeftAnti" in first and "Aggregate" not in first[: first.index("LeftAnti")]
