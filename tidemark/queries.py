"""The registered queries, one for each operator family, and their SQL.

Tables are entity tables whose rows carry their primary key as id; lineitem rows have none. All
run over whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.db import Db
from tidemark.model import Catalog, entity_table
from tidemark.operators.pull import pull_columns
from tidemark.operators.temporal import as_of, history
from tidemark.operators.text import TextIndex, facts, search_texts
from tidemark.plans.sparql import translate
from tidemark.sources.connect import as_text, records_to_ops
from tidemark.sources.ntriples import parse_ntriples
from tidemark.sql import Sql
from tidemark.stored import StoredNode
from tidemark.streaming.ingest import LogIngest, documents_of, fold_log
from tidemark.workspace import shared_root

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id"}


def database(spark: SparkSession, sf_dir: str, *names: str) -> Db:
    catalog = Catalog()
    for name in names:
        catalog.add(entity_table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name]))
    return Db(spark, catalog)


def money(name: str, places: int = 2) -> Column:
    return F.round(F.col(name) + F.lit(0.0), places).alias(name)


Registered = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]
REGISTERED: Registered = {}


def register(sql: str | None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTERED[fn.__name__] = (fn, sql)
        return fn

    return add


# Scans, ranges, aggregates, sorting.


@register("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '2001-08-01' GROUP BY ALL""")
def agg_group_sort(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "lineitem").df("""
      {:find [f s (sum q) (sum p) (sum dp) (sum ch) (avg q) (avg p) (avg disc) (count q)]
       :keys [l_returnflag l_linestatus sum_qty sum_base sum_disc sum_charge avg_qty avg_price avg_disc n]
       :where [[l :l_returnflag f] [l :l_linestatus s] [l :l_quantity q] [l :l_extendedprice p] [l :l_discount disc] [l :l_tax t] [l :l_shipdate ship]
               [(<= ship #inst "2001-08-01")] [(- 1 disc) keep] [(* p keep) dp] [(+ 1 t) up] [(* dp up) ch]]
       :order-by [[f :asc] [s :asc]]}""")
    return out.select("l_returnflag", "l_linestatus", money("sum_qty"), money("sum_base"), money("sum_disc"), money("sum_charge"), money("avg_qty", 4), money("avg_price", 4), money("avg_disc", 6), "n")


@register("""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount >= 0.045 AND l_discount <= 0.075 AND l_quantity < 24""")
def filter_agg(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "lineitem").df("""
      {:find [(sum r)] :keys [revenue]
       :where [[l :l_extendedprice p] [l :l_discount disc] [l :l_quantity q] [l :l_shipdate ship]
               [(>= ship #inst "1997-01-01")] [(< ship #inst "1998-01-01")] [(>= disc 0.045)] [(<= disc 0.075)] [(< q 24)] [(* p disc) r]]}""").select(money("revenue"))


@register("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 10""")
def join3_topk(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "orders", "lineitem").df("""
      {:find [o (sum r) date] :keys [l_orderkey revenue o_orderdate]
       :where [[c :c_mktsegment "BUILDING"] [o :o_custkey c] [o :o_orderdate date] [l :l_orderkey o] [l :l_extendedprice p] [l :l_discount disc] [l :l_shipdate ship]
               [(< date #inst "1998-03-15")] [(> ship #inst "1998-03-15")] [(- 1 disc) keep] [(* p keep) r]]
       :order-by [[(sum r) :desc] [o :asc]] :limit 10}""").select("l_orderkey", money("revenue"), "o_orderdate")


@register("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY n_name""")
def join6_cycle(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region").df("""
      {:find [name (sum r)] :keys [n_name revenue]
       :where [[c :c_nationkey n] [o :o_custkey c] [o :o_orderdate date] [l :l_orderkey o] [l :l_suppkey s] [l :l_extendedprice p] [l :l_discount disc]
               [s :s_nationkey n] [n :n_name name] [n :n_regionkey g] [g :r_name "ASIA"]
               [(>= date #inst "1997-01-01")] [(< date #inst "1999-01-01")] [(- 1 disc) keep] [(* p keep) r]]}""").select("n_name", money("revenue"))


@register("""
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY ALL""")
def join4_groups(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "orders", "lineitem", "nation").df("""
      {:find [c name (sum r) bal nation] :keys [c_custkey c_name revenue c_acctbal n_name]
       :where [[c :c_name name] [c :c_acctbal bal] [c :c_nationkey n] [n :n_name nation] [o :o_custkey c] [o :o_orderdate date] [l :l_orderkey o] [l :l_returnflag "R"]
               [l :l_extendedprice p] [l :l_discount disc] [(>= date #inst "1997-10-01")] [(< date #inst "1998-01-01")] [(- 1 disc) keep] [(* p keep) r]]}""").select("c_custkey", "c_name", money("revenue"), money("c_acctbal"), "n_name")


# Shapes over what a supplier has of a part, which the lines tell.

_SUPPLY = "supply AS (SELECT l_partkey AS ps_part, l_suppkey AS ps_supp, min(l_extendedprice / l_quantity) AS ps_cost, sum(l_quantity) AS ps_avail FROM lineitem GROUP BY l_partkey, l_suppkey)"


def stocked(spark: SparkSession, d: str, *names: str) -> Db:
    db = database(spark, d, *names)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("ps_part"), F.col("l_suppkey").alias("ps_supp"))
    supply = lines.agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_cost"), F.sum("l_quantity").alias("ps_avail"))
    db.catalog.add(entity_table("supply", supply, None))
    return db


@register(f"""
WITH {_SUPPLY}, near AS (SELECT * FROM supply JOIN supplier ON s_suppkey = ps_supp JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE')
SELECT p_partkey, s_suppkey, round(s_acctbal, 2) AS s_acctbal, n_name, round(ps_cost, 2) AS ps_cost FROM near x JOIN part ON p_partkey = ps_part
WHERE p_size < 15 AND p_type LIKE '%MY' AND ps_cost = (SELECT min(ps_cost) FROM near y WHERE y.ps_part = x.ps_part)""")
def cheapest_supply(spark: SparkSession, d: str) -> DataFrame:
    """Who offers a part at its least price in a region: a correlated minimum."""
    return stocked(spark, d, "part", "supplier", "nation", "region").df("""
      {:find [p s bal nation cost] :keys [p_partkey s_suppkey s_acctbal n_name ps_cost]
       :where [[p :p_size z] [(< z 15)] [p :p_type kind] [(re-find "MY$" kind)] [h :ps_part p] [h :ps_supp s] [h :ps_cost cost] [s :s_acctbal bal] [s :s_nationkey n] [n :n_name nation] [n :n_regionkey g] [g :r_name "EUROPE"]
               [(q {:find [(min c)] :in [p] :where [[k :ps_part p] [k :ps_cost c] [k :ps_supp t] [t :s_nationkey m] [m :n_regionkey r] [r :r_name "EUROPE"]]} p) [[least]]] [(= cost least)]]}""").select("p_partkey", "s_suppkey", money("s_acctbal"), "n_name", money("ps_cost"))


@register("""
SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
WHERE ((a.n_name = 'NATION_3' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_3')) AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31' GROUP BY ALL""")
def trade_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Trade between two nations, both ways."""
    out = database(spark, d, "lineitem", "orders", "customer", "supplier", "nation").df("""
      {:find [from to y (sum v)] :keys [supp_nation cust_nation l_year revenue]
       :where [[l :l_orderkey o] [o :o_custkey c] [c :c_nationkey cn] [cn :n_name to] [l :l_suppkey s] [s :s_nationkey sn] [sn :n_name from]
               (or (and [(= from "NATION_3")] [(= to "NATION_7")]) (and [(= from "NATION_7")] [(= to "NATION_3")]))
               [l :l_shipdate day] [(>= day #inst "1996-01-01")] [(<= day #inst "1999-12-31")] [l :l_discount disc] [l :l_extendedprice price] [(- 1 disc) keep] [(* price keep) v] [(year day) y]]
       :order-by [[from :asc] [to :asc] [y :asc]]}""")
    return out.select("supp_nation", "cust_nation", F.col("l_year").cast("int").alias("l_year"), money("revenue"))


@register("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(CASE WHEN b.n_name = 'NATION_7' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN region ON r_regionkey = a.n_regionkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1""")
def market_share(spark: SparkSession, d: str) -> DataFrame:
    """A nation's share of a region's purchases: sums of a nested query, one of them of a looked-up value."""
    out = database(spark, d, "lineitem", "orders", "customer", "supplier", "part", "nation", "region").df("""
      {:find [y share] :keys [o_year mkt_share]
       :where [[(q {:find [y (sum own) (sum v)]
                    :where [[(q {:find [y (sum r) nation]
                                 :where [[l :l_orderkey o] [l :l_suppkey s] [l :l_partkey p] [o :o_custkey c] [c :c_nationkey cn] [cn :n_regionkey g] [g :r_name "AMERICA"] [s :s_nationkey sn] [sn :n_name nation]
                                         [p :p_type "ECONOMY"] [o :o_orderdate day] [(>= day #inst "1996-01-01")] [(< day #inst "2000-01-01")] [l :l_extendedprice price] [l :l_discount disc] [(- 1 disc) keep] [(* price keep) r] [(year day) y]]}) [[y v nation]]]
                            [(hash-map "NATION_7" v) found] [(get found nation 0) own]]}) [[y mine all]]]
               [(/ mine all) share]]
       :order-by [[y :asc]]}""")
    return out.select(F.col("o_year").cast("int").alias("o_year"), F.round("mkt_share", 6).alias("mkt_share"))


@register(f"""
WITH {_SUPPLY} SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_cost * l_quantity), 1) AS profit
FROM lineitem JOIN supply ON ps_part = l_partkey AND ps_supp = l_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
WHERE p_name LIKE '%red%' GROUP BY ALL""")
def profit_by_year(spark: SparkSession, d: str) -> DataFrame:
    """A join by two keys, and a pattern."""
    out = stocked(spark, d, "lineitem", "orders", "supplier", "part", "nation").df("""
      {:find [nation y (sum gain)] :keys [n_name o_year profit]
       :where [[l :l_orderkey o] [l :l_suppkey s] [l :l_partkey p] [h :ps_part p] [h :ps_supp s] [h :ps_cost cost] [s :s_nationkey n] [n :n_name nation] [p :p_name name] [(re-find "red" name)]
               [l :l_quantity q] [l :l_discount disc] [l :l_extendedprice price] [o :o_orderdate day] [(- 1 disc) keep] [(* price keep) in] [(* cost q) out] [(- in out) gain] [(year day) y]]
       :order-by [[nation :asc] [y :desc]]}""")
    return out.select("n_name", F.col("o_year").cast("int").alias("o_year"), money("profit", 1))


@register(f"""
WITH {_SUPPLY}, held AS (SELECT ps_part, sum(ps_cost * ps_avail) AS worth FROM supply JOIN supplier ON s_suppkey = ps_supp JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' GROUP BY ps_part)
SELECT ps_part AS p_partkey, round(worth, 1) AS worth FROM held WHERE worth > (SELECT 0.002 * sum(worth) FROM held)""")
def important_stock(spark: SparkSession, d: str) -> DataFrame:
    """Parts that make up much of a nation's stock: a group's sum against a share of the whole."""
    return stocked(spark, d, "supplier", "nation").df("""
      {:find [p worth] :keys [p_partkey worth]
       :where [[(q {:find [(sum x)] :where [[h :ps_avail a] [h :ps_cost c] [h :ps_supp s] [h :ps_part p] [s :s_nationkey n] [n :n_name "NATION_3"] [(* c a) x]]}) [[whole]]]
               [(q {:find [p (sum x)] :where [[h :ps_avail a] [h :ps_cost c] [h :ps_supp s] [h :ps_part p] [s :s_nationkey n] [n :n_name "NATION_3"] [(* c a) x]]}) [[p worth]]]
               [(* 0.002 whole) least] [(> worth least)]]
       :order-by [[worth :desc]]}""").select("p_partkey", money("worth", 1))


@register("""
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND o_orderdate < l_shipdate GROUP BY l_returnflag""")
def priority_by_flag(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a table of values within the query, bound as a tuple."""
    out = database(spark, d, "lineitem", "orders").df("""
      {:find [f (sum high) (sum low)] :keys [l_returnflag high low]
       :where [[l :l_orderkey o] [l :l_shipdate ship] [l :l_returnflag f] [l :l_returnflag #{"A" "R"}] [l :l_linenumber k] [o :o_orderpriority pri] [o :o_orderdate day]
               [(>= ship #inst "1997-01-01")] [(< ship #inst "1998-01-01")] [(< day ship)] [(get {"1-URGENT" [1 0] "2-HIGH" [1 0]} pri [0 1]) [high low]]]
       :order-by [[f :asc]]}""")
    return out.select("l_returnflag", F.col("high").cast("long").alias("high"), F.col("low").cast("long").alias("low"))


@register("""
SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1998-09-01' AND l_shipdate < TIMESTAMP '1998-10-01'""")
def promo_share(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "lineitem", "part").df("""
      {:find [promo] :keys [promo]
       :where [[(q {:find [(sum some) (sum v)]
                    :where [[l :l_partkey p] [p :p_type kind] [l :l_shipdate ship] [l :l_extendedprice price] [l :l_discount disc] [(>= ship #inst "1998-09-01")] [(< ship #inst "1998-10-01")] [(- 1 disc) keep] [(* price keep) v]
                            [(clojure.string/starts-with? kind "PROMO") promo?] [(hash-map true v) found] [(get found promo? 0) some]]}) [[part whole]]]
               [(/ part whole) share] [(* 100 share) promo]]}""").select(F.round("promo", 4).alias("promo"))


@register(f"""
WITH {_SUPPLY} SELECT DISTINCT s_name FROM supply x JOIN part ON p_partkey = ps_part JOIN supplier ON s_suppkey = ps_supp JOIN nation ON n_nationkey = s_nationkey
WHERE p_name LIKE 'red%' AND n_regionkey = 1 AND ps_avail > (SELECT 0.9 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_part AND l_suppkey = ps_supp AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')""")
def excess_stock(spark: SparkSession, d: str) -> DataFrame:
    """A sub-query that depends on two values of the outer one."""
    return stocked(spark, d, "lineitem", "part", "supplier", "nation").df("""
      {:find [name] :keys [s_name]
       :where [[h :ps_supp s] [h :ps_part p] [h :ps_avail avail] [p :p_name kind] [(re-find "^red" kind)] [s :s_name name] [s :s_nationkey n] [n :n_regionkey 1]
               [(q {:find [(sum q)] :in [p s] :where [[l :l_partkey p] [l :l_suppkey s] [l :l_quantity q] [l :l_orderkey o] [l :l_shipdate ship] [(>= ship #inst "1996-01-01")] [(< ship #inst "1999-01-01")]]} p s) [[sold]]]
               [(* sold 0.9) least] [(> avail least)]]}""")


@register("""
SELECT s_name, count(*) AS n FROM lineitem x JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND n_regionkey = 2 AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_suppkey <> x.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem z WHERE z.l_orderkey = x.l_orderkey AND z.l_suppkey <> x.l_suppkey AND z.l_returnflag = 'R') GROUP BY s_name ORDER BY n DESC, s_name LIMIT 100""")
def lone_returns(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose lines alone came back of orders that others had a part in: exists and not exists by two values."""
    return database(spark, d, "lineitem", "orders", "supplier", "nation").df("""
      {:find [name (count k)] :keys [s_name n]
       :where [[l :l_suppkey s] [l :l_orderkey o] [l :l_linenumber k] [l :l_partkey part] [l :l_returnflag "R"] [s :s_name name] [s :s_nationkey n] [n :n_regionkey 2] [o :o_orderstatus "F"]
               (or-join [o s] (and [y :l_orderkey o] [y :l_suppkey other] [(!= other s)]))
               (not-join [o s] [z :l_orderkey o] [z :l_suppkey other] [z :l_returnflag "R"] [(!= other s)])]
       :order-by [[(count k) :desc] [name :asc]] :limit 100}""")


# Alternatives, negation, semi-joins.


@register("""
SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE (p_brand = 'Brand#11' AND l_quantity >= 1 AND l_quantity <= 11) OR (p_brand = 'Brand#22' AND l_quantity >= 10 AND l_quantity <= 20) OR (p_size < 5 AND l_quantity > 45)""")
def or_branches(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "lineitem", "part").df("""
      {:find [(count price) (sum price)] :keys [n total]
       :where [[l :l_partkey p] [l :l_quantity q] [l :l_extendedprice price] [p :p_brand b] [p :p_size z]
               (or (and [(= b "Brand#11")] [(>= q 1)] [(<= q 11)] [(identity z)]) (and [(= b "Brand#22")] [(>= q 10)] [(<= q 20)] [(identity z)]) (and [(< z 5)] [(> q 45)] [(identity b)]))]}""").select("n", money("total"))


@register("SELECT p_partkey, tag FROM (SELECT p_partkey, 'small' AS tag FROM part WHERE p_size < 10 UNION SELECT p_partkey, p_brand FROM part WHERE p_size > 40)")
def or_new_var(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "part").df("""
      {:find [p tag] :keys [p_partkey tag]
       :where [(or (and [p :p_size z1] [(< z1 10)] [(identity "small") tag] [(identity z1) z]) (and [p :p_size z] [(> z 40)] [p :p_brand tag] [(identity z) z1]))]}""")


@register("""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority""")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders", "lineitem").df("""
      {:find [pri (count o)] :keys [o_orderpriority n]
       :where [[o :o_orderpriority pri] [o :o_orderdate date] [(>= date #inst "1997-07-01")] [(< date #inst "1997-10-01")]
               (or-join [o] (and [l :l_orderkey o] [l :l_quantity q] [(> q 40)]))]}""")


@register("""
SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def not_clause(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "orders").df("""
      {:find [c] :keys [c_custkey] :where [[c :c_acctbal b] [(> b 0)] (not-join [c] [o :o_custkey c] [o :o_orderpriority "1-URGENT"])]}""")


@register("SELECT p_partkey FROM part WHERE NOT (p_brand = 'Brand#11' OR p_size > 20)")
def not_nested(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "part").df("""
      {:find [p] :keys [p_partkey] :where [[p :p_brand b] [p :p_size z] (not (or (and [(= b "Brand#11")] [(identity z)]) (and [(> z 20)] [(identity b)])))]}""")


@register("""
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON o_custkey = c_custkey GROUP BY c_custkey""")
def left_default(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "orders").df("""
      {:find [c n] :keys [c_custkey n]
       :where [[c :c_name]
               (or-join [c n]
                 [(q {:find [c (count o)] :where [[o :o_custkey c] [o :o_totalprice t] [(> t 200000)]]}) [[c n]]]
                 (and [c :c_name] (not-join [c] [o :o_custkey c] [o :o_totalprice t] [(> t 200000)]) [(identity 0) n]))]}""").select("c_custkey", F.col("n").cast("long").alias("n"))


@register("SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN 'yes' END, 'no') AS rich FROM supplier")
def get_attr_default(spark: SparkSession, d: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.when(F.col("s_acctbal") > 0, "yes").alias("rich"))
    db = Db(spark, Catalog().add(entity_table("supplier", suppliers, "s_suppkey")))
    return db.df('{:find [s r] :keys [s_suppkey rich] :where [[s :s_suppkey] [(get-attr s :rich "no") [r ...]]]}')


# Theta joins, self joins, unification.


@register("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_range(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "nation").df('{:find [a b] :where [[x :n_regionkey g] [y :n_regionkey g] [x :n_name a] [y :n_name b] [x :n_nationkey i] [y :n_nationkey j] [(< i j)]]}')


@register("SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey")
def self_join_neq(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "supplier").df("{:find [(count b)] :keys [n] :where [[a :s_nationkey g] [b :s_nationkey g] [(!= a b)]]}")


@register("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('O', 'P')")
def unify_set(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df('{:find [o p] :keys [o_orderkey o_orderpriority] :where [[o :o_orderpriority p] [(== p #{"1-URGENT" "5-LOW"})] [o :o_orderstatus #{"O" "P"}]]}')


# Sub-queries.


@register("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def subq_scalar(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df("""
      {:find [o] :keys [o_orderkey] :where [[o :o_totalprice t] [(q {:find [(avg x)] :where [[_ :o_totalprice x]]}) [[mean]]] [(* mean 1.8) least] [(> t least)]]}""")


@register("""
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")
def subq_corr(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "lineitem", "part").df("""
      {:find [(sum price)] :keys [total]
       :where [[p :p_brand "Brand#23"] [l :l_partkey p] [l :l_quantity q] [l :l_extendedprice price]
               [(q {:find [(avg x)] :in [p] :where [[k :l_partkey p] [k :l_quantity x]]} p) [[mean]]] [(* 0.5 mean) most] [(< q most)]]}""").select(F.round(F.col("total") / 7.0, 2).alias("avg_yearly"))


@register("""
SELECT c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(s, 2) AS quantity FROM (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) t
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def subq_rel(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "lineitem", "orders", "customer").df("""
      {:find [name o t s] :keys [c_name o_orderkey o_totalprice quantity]
       :where [[(q {:find [k (sum x)] :where [[l :l_orderkey k] [l :l_quantity x]]}) [[o s]]] [(> s 250)] [o :o_custkey c] [o :o_totalprice t] [c :c_name name]]}""").select("c_name", "o_orderkey", money("o_totalprice"), money("quantity"))


# Aggregates.


@register("SELECT o_orderstatus, round(median(o_totalprice), 2) AS med, round(var_pop(o_totalprice) / 1e6, 2) AS var, round(stddev_pop(o_totalprice), 2) AS dev FROM orders GROUP BY o_orderstatus")
def agg_median_var_std(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "orders").df("{:find [s (median t) (variance t) (stddev t)] :keys [o_orderstatus med var dev] :where [[o :o_orderstatus s] [o :o_totalprice t]]}")
    return out.select("o_orderstatus", money("med"), F.round(F.col("var") / 1e6, 2).alias("var"), money("dev"))


@register("""
SELECT p_brand, to_json(list_sort(list_distinct(list(p_size)))[1:3]) AS least, to_json(list_sort(list_distinct(list(p_size)))[-3:]) AS most FROM part GROUP BY p_brand""")
def agg_minmax_n(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "part").df("{:find [b (min 3 z) (max 3 z)] :keys [p_brand least most] :where [[p :p_brand b] [p :p_size z]]}")
    return out.select("p_brand", F.to_json("least").alias("least"), F.to_json("most").alias("most"))


@register("SELECT p_brand, 5 AS drawn, true AS known, least(3, count(DISTINCT p_size)) AS sampled, true AS differ FROM part GROUP BY p_brand")
def agg_rand_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five values drawn with repeats, three without: how many there are, and whether they are the group's and differ."""
    out = database(spark, d, "part").df("{:find [b (rand 5 z) (sample 3 z) (distinct z)] :keys [p_brand r s all] :where [[p :p_brand b] [p :p_size z]]}")
    known = F.size(F.array_except(F.concat("r", "s"), "all")) == 0
    return out.select("p_brand", F.size("r").alias("drawn"), known.alias("known"), F.size("s").alias("sampled"), (F.size(F.array_distinct("s")) == F.size("s")).alias("differ"))


@register("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS n, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df("{:find [s (count-distinct c) (count o) (min day) (max day)] :keys [o_orderstatus customers n first_day last_day] :where [[o :o_orderstatus s] [o :o_custkey c] [o :o_orderdate day]]}")


@register("SELECT n_regionkey, to_json(list_sort(list_distinct(list(n_name)))) AS names FROM nation GROUP BY n_regionkey")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "nation").df("{:find [g (distinct name)] :keys [n_regionkey names] :where [[n :n_regionkey g] [n :n_name name]]}")
    return out.select("n_regionkey", F.to_json(F.array_sort("names")).alias("names"))


@register("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < (SELECT min(o_totalprice) FROM orders WHERE o_orderstatus = 'P') GROUP BY o_orderstatus")
def agg_empty(spark: SparkSession, d: str) -> DataFrame:
    """A group without rows is no group: no order of status P is below the least of its own."""
    return database(spark, d, "orders").df("""
      {:find [s (count o)] :keys [o_orderstatus n] :where [[o :o_totalprice t] [o :o_orderstatus s] [(q {:find [(min x)] :where [[y :o_totalprice x] [y :o_orderstatus "P"]]}) [[least]]] [(< t least)]]}""")


# Inputs.


@register("SELECT o_orderkey, w FROM orders JOIN (VALUES ('1-URGENT', 3), ('5-LOW', 1)) v(p, w) ON o_orderpriority = p WHERE o_totalprice > 300000")
def in_relation(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df("{:find [o w] :keys [o_orderkey w] :in [[[p w]] least] :where [[o :o_orderpriority p] [o :o_totalprice t] [(> t least)]]}", [("1-URGENT", 3), ("5-LOW", 1)], 300000)


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7")
def in_collection(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer").df("{:find [c name] :keys [c_custkey c_name] :in [[seg ...] n] :where [[c :c_mktsegment seg] [c :c_nationkey n] [c :c_name name]]}", ["BUILDING", "MACHINERY"], 7)


# Functions and bindings.


@register("SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def explode_collection(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "part").df('{:find [w (count p)] :keys [word n] :where [[p :p_name name] [(split name " ") [w ...]]]}')


@register("""
SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 7, 2) AS num, p_size % 7 AS m, p_size // 7 AS qt, greatest(p_size, 25) AS big, CAST(year(DATE '2001-02-03') AS INTEGER) AS y, length(p_type) AS len
, regexp_matches(p_type, '^S') AS s FROM part WHERE p_size & 1 = 1""")
def str_math_date_fns(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "part").df("""
      {:find [p up num m qt big y len s] :keys [p_partkey up num m qt big y len s]
       :where [[p :p_name name] [p :p_brand b] [p :p_size z] [p :p_type t] [(odd? z)] [(clojure.string/upper-case name) up] [(subs b 6 8) num] [(mod z 7) m] [(quot z 7) qt] [(max z 25) big]
               [(year #inst "2001-02-03") y] [(count t) len] [(starts-with? t "S") s]]}""")


@register("SELECT event_id, user_id, event_type FROM events")
def tuple_binding(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "events").df("{:find [e u k] :keys [event_id user_id event_type] :where [[e :user_id u0] [e :event_type k0] [(identity u0) u] [(vector k0) [k]]]}")


# Sets, bags, paging.


@register("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df("{:find [s p] :keys [o_orderstatus o_orderpriority] :where [[o :o_orderstatus s] [o :o_orderpriority p]]}")


@register("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def bag_limit(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "orders").df("{:find [o t] :keys [o_orderkey o_totalprice] :where [[o :o_totalprice t]] :order-by [[t :desc] [o :asc]] :limit 20 :offset 10}").select("o_orderkey", money("o_totalprice"))


# Time.


def versions(spark: SparkSession, d: str, retroactive: bool = False) -> DataFrame:
    """Events as versions of users: the event is the transaction; retroactively recorded ones were true up to six days before."""
    events = spark.read.parquet(f"{d}/events.parquet")
    vt = F.expr("ts - make_dt_interval(CAST(event_id % 7 AS INT))") if retroactive else F.col("ts")
    return events.select(F.col("user_id").alias("eid"), vt.alias("vt"), F.col("ts").alias("tt"), F.col("event_id").alias("tx_id"), "event_type", "value")


@register("SELECT user_id AS eid, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def asof_valid(spark: SparkSession, d: str) -> DataFrame:
    return as_of(versions(spark, d), datetime(2024, 1, 15), payload=["event_type"]).select("eid", "event_type")


@register("""
SELECT user_id AS eid, arg_max(event_type, (ts - to_days(CAST(event_id % 7 AS INTEGER)), event_id)) AS event_type, round(arg_max(value, (ts - to_days(CAST(event_id % 7 AS INTEGER)), event_id)), 4) AS value
FROM events WHERE ts - to_days(CAST(event_id % 7 AS INTEGER)) <= TIMESTAMP '2024-01-15' AND event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id""")
def asof_bitemporal(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d, retroactive=True)
    half = rows.agg(F.expr("max(tx_id) div 2")).first()[0]
    return as_of(rows, datetime(2024, 1, 15), half, payload=["event_type", "value"]).select("eid", "event_type", money("value", 4))


@register("""
SELECT eid, vt, tx_id, event_type FROM (SELECT user_id AS eid, date_trunc('day', ts) AS vt, event_id AS tx_id, event_type, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) AS n FROM events)
WHERE n = 1 AND vt >= TIMESTAMP '2024-01-05' AND vt < TIMESTAMP '2024-01-20'""")
def history_desc(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d).withColumn("vt", F.date_trunc("day", "vt"))
    return history(rows.where((F.col("vt") >= F.lit(datetime(2024, 1, 5))) & (F.col("vt") < F.lit(datetime(2024, 1, 20)))), descending=True).select("eid", "vt", "tx_id", "event_type")


@register("SELECT user_id AS eid, date_trunc('day', ts) AS vt, event_id AS tx_id, event_type FROM events WHERE date_trunc('day', ts) >= TIMESTAMP '2024-01-05' AND date_trunc('day', ts) < TIMESTAMP '2024-01-08'")
def history_corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d).withColumn("vt", F.date_trunc("day", "vt"))
    return history(rows, start=(datetime(2024, 1, 5),), end=(datetime(2024, 1, 8),), corrections=True).select("eid", "vt", "tx_id", "event_type")


@register("SELECT event_type, date_trunc('hour', ts) AS hour, round(min(value), 4) AS low, round(max(value), 4) AS high, count(*) AS n FROM events GROUP BY ALL")
def hour_bucket_minmax(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "events").df("""
      {:find [k h (min v) (max v) (count e)] :keys [event_type hour low high n] :where [[e :event_type k] [e :ts t] [e :value v] [(date-trunc "hour" t) h]]}""")
    return out.select("event_type", "hour", money("low", 4), money("high", 4), "n")


@register("SELECT event_type, count(*) AS users FROM (SELECT arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id) GROUP BY event_type")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Users by their last event as of a valid time: temporal resolution under a compiled query."""
    current = as_of(versions(spark, d), datetime(2024, 1, 15), payload=["event_type"])
    db = Db(spark, Catalog().add(entity_table("users", current, "eid")))
    return db.df("{:find [k (count u)] :keys [event_type users] :where [[u :event_type k]] :order-by [[k :asc]]}")


# Rules.

_EDGES = "SELECT p_partkey AS a, p_partkey // 3 AS b FROM part"


def graph(spark: SparkSession, d: str) -> Db:
    """Parts as a tree that grows with the table: part n hangs on part n // 3, the root on itself."""
    edges = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 3").alias("b"), "p_brand")
    return Db(spark, Catalog().add(entity_table("edges", edges, "a")))


@register(f"WITH RECURSIVE e AS ({_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def rule_recursive(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).df("{:find [a b] :where [(reaches a b)] :rules [[(reaches a b) [a :b b]] [(reaches a b) (reaches a x) (reaches x b)]]}")


@register(f"WITH RECURSIVE e AS ({_EDGES}), r(a, b, odd) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, 1 - r.odd FROM r JOIN e ON r.b = e.a) SELECT DISTINCT a, b FROM r WHERE odd = 0")
def rule_mutual(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).df("{:find [a b] :where [(even a b)] :rules [[(odd a b) [a :b b]] [(odd a b) (even a x) [x :b b]] [(even a b) (odd a x) [x :b b]]]}")


@register(f"WITH RECURSIVE e AS ({_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a FROM e WHERE NOT EXISTS (SELECT 1 FROM r JOIN part ON p_partkey = r.b WHERE r.a = e.a AND p_brand = 'Brand#7')")
def rule_negation(spark: SparkSession, d: str) -> DataFrame:
    """Parts above which there is none of a brand."""
    return graph(spark, d).df("""
      {:find [a] :where [(free a)]
       :rules [[(reaches a b) [a :b b]] [(reaches a b) (reaches a x) [x :b b]] [(branded a) (reaches a x) [x :p_brand "Brand#7"]] [(free a) [a :b _] (not (branded a))]]}""")


# Pull.


@register("""
SELECT o_orderkey, c_name, n_name, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'none' END AS note FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'""")
def pull_forward(spark: SparkSession, d: str) -> DataFrame:
    """Along references, with a default where a customer lacks the attribute."""
    db = database(spark, d, "orders", "nation")
    customers = spark.read.parquet(f"{d}/customer.parquet").withColumn("c_note", F.when(F.col("c_acctbal") > 5000, "rich"))
    db.catalog.add(entity_table("customer", customers, "c_custkey"))
    ids = db.df('{:find [o] :keys [eid] :where [[o :o_orderstatus "P"]]}')
    pulled = pull_columns(db.catalog, ids, '[:o_orderkey {:o_custkey [:c_name (:c_note {:default "none"}) {:c_nationkey [:n_name]}]}]')
    return pulled.select(F.col("eid").alias("o_orderkey"), F.col("pulled.o_custkey.c_name"), F.col("pulled.o_custkey.c_nationkey.n_name"), F.col("pulled.o_custkey.c_note").alias("note"))


@register("SELECT r_name, to_json(list_sort(list(n_name))) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def pull_reverse(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d, "region", "nation")
    ids = db.df("{:find [g] :keys [eid] :where [[g :r_name]]}")
    pulled = pull_columns(db.catalog, ids, "[:r_name {:_n_regionkey [:n_name]}]")
    return pulled.select("pulled.r_name", F.to_json(F.array_sort(F.transform(F.col("pulled._n_regionkey"), lambda n: n["n_name"]))).alias("nations"))


# Full text.


def _bm25(texts: str) -> str:
    """Tables of (doc_id, v) values in SQL: u(values), p(postings), r(rarities), s(scores)."""
    return rf"""
d AS ({texts}), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(v), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM d WHERE v IS NOT NULL),
u AS (SELECT doc_id, w, len(w) AS size FROM w WHERE len(w) > 0), m AS (SELECT count(*) AS n, avg(size) AS mean FROM u),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, size, unnest(w) AS term FROM u) GROUP BY ALL),
r AS (SELECT term, ln(1 + (n - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) AS idf FROM p, m GROUP BY term, n),
s AS (SELECT doc_id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS score FROM p JOIN r USING (term), m)"""


@register(f"""WITH {_bm25("SELECT doc_id, text AS v FROM documents")}
SELECT doc_id, round(sum(score), 5) AS score FROM s WHERE term = 'idiot' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'moron') GROUP BY doc_id""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d, "documents")
    return db.df('{:find [e score] :keys [doc_id score] :where [[(text-search :text "idiot AND NOT moron") [[e v score]]]]}').select(F.col("doc_id").cast("long").alias("doc_id"), money("score", 5))


@register(f"""WITH {_bm25("SELECT doc_id, text AS v FROM documents")},
f AS (SELECT doc_id, size, len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'licensed' AND w[i + 1] = 'under' AND w[i + 2] = 'the')) AS tf FROM u),
i AS (SELECT sum(idf) AS idf FROM r WHERE term IN ('licensed', 'under', 'the'))
SELECT doc_id, round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 5) AS score FROM f, i, m WHERE tf > 0""")
def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Words that follow each other, by their places."""
    found = search_texts(facts(database(spark, d, "documents").catalog, "text"), '"licensed under the"', ["e"])
    return found.select(F.col("e").cast("long").alias("doc_id"), money("score", 5))


@register(f"""WITH {_bm25("SELECT doc_id, text AS v FROM documents")}
SELECT doc_id, round(sum(score * CASE WHEN term LIKE 'idio%' THEN 2 ELSE 1 END), 5) AS score FROM s WHERE term LIKE 'idio%' OR levenshtein(term, 'moron') <= 1 GROUP BY doc_id""")
def text_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A boosted prefix or a fuzzy word."""
    found = search_texts(facts(database(spark, d, "documents").catalog, "text"), "idio*^2 OR moron~1", ["e"])
    return found.select(F.col("e").cast("long").alias("doc_id"), money("score", 5))


@register(f"""WITH {_bm25("SELECT doc_id || '/text' AS doc_id, text AS v FROM documents UNION ALL SELECT doc_id || '/lang', lang FROM documents UNION ALL SELECT doc_id || '/source', source FROM documents")}
SELECT split_part(doc_id, '/', 1) AS doc_id, split_part(doc_id, '/', 2) AS attr, round(sum(score), 5) AS score FROM s WHERE term LIKE 'cl_wn%' OR term = 'fr' GROUP BY ALL""")
def text_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """All attributes: each value that matches, with its attribute."""
    out = database(spark, d, "documents").df('{:find [e a score] :keys [doc_id attr score] :where [[(wildcard-text-search "cl?wn* OR fr") [[e v a score]]]]}')
    return out.select("doc_id", "attr", money("score", 5))


@register(f"""WITH {_bm25("SELECT doc_id, concat_ws(' ', text, lang, source) AS v FROM documents")},
t AS (SELECT doc_id, size, len(list_filter(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), lambda t: t = 'idiot')) AS tf FROM documents JOIN u USING (doc_id)),
x AS (SELECT doc_id, size, tf, n, mean, count(*) OVER () AS df FROM t, m WHERE tf > 0),
l AS (SELECT doc_id, size, n, mean, count(*) OVER () AS df FROM documents JOIN u USING (doc_id), m WHERE lang = 'en')
SELECT doc_id, round(ln(1 + (x.n - x.df + 0.5) / (x.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * x.size / x.mean)) + ln(1 + (l.n - l.df + 0.5) / (l.df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * l.size / l.mean)), 5) AS score FROM x JOIN l USING (doc_id)""")
def text_multi(spark: SparkSession, d: str) -> DataFrame:
    """Several attributes of one entity at once."""
    out = database(spark, d, "documents").df('{:find [e score] :keys [doc_id score] :where [[(multi-text-search "text:%s AND lang:%s" "idiot" "en") [[e score]]]]}')
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), money("score", 5))


def stored_index(spark: SparkSession, d: str) -> Db:
    """Documents with a stored index of their texts: all are indexed, then those of one language are evicted, then it is compacted."""
    db = database(spark, d, "documents")
    text = TextIndex(spark, f"{shared_root(spark)}/tidemark/text-{uuid.uuid4().hex}").build(db.catalog, "text")
    gone = db.catalog.tables["documents"].df.where("lang = 'de'").select(F.col("doc_id").alias("e"))
    text.update(facts(db.catalog, "text").limit(0), 1, gone)
    text.compact()
    db.catalog.text = text
    return db


@register(f"""WITH {_bm25("SELECT doc_id, text AS v FROM documents WHERE lang <> 'de'")}
SELECT doc_id, round(sum(score), 5) AS score FROM s WHERE term IN ('idiot', 'stupid') GROUP BY doc_id ORDER BY sum(score) DESC, CAST(doc_id AS VARCHAR) LIMIT 20 OFFSET 5""")
def text_stored(spark: SparkSession, d: str) -> DataFrame:
    """A page of the best of a stored index."""
    found = stored_index(spark, d).catalog.text.search("idiot OR stupid", limit=20, offset=5)
    return found.select(F.col("e").cast("long").alias("doc_id"), money("score", 5))


# Statistics, windows, grouping sets.


@register(" UNION ALL ".join(f"SELECT '{c}' AS attr, count({c}) AS n FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")))
def attribute_stats(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sorted(database(spark, d, "orders").attribute_stats().items()), "attr string, n long")


@register("SELECT * FROM (SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY customer.c_acctbal DESC, c_custkey) AS BIGINT) AS r FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE r <= 3")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    """A window over a table that a query defines, with a parameter."""
    sql = Sql(spark, lambda **_: database(spark, d, "customer"))
    sql.create_table("richest", '{:find [?n ?c ?b] :where [[?c :c_nationkey ?n] [?c :c_acctbal ?b] [?c :c_mktsegment ?s] [(!= ?s "BUILDING")]]}', {"?n": "bigint", "?c": "bigint", "?b": "double"})
    out = sql.sql("SELECT * FROM (SELECT n, c, {fn ROUND(b, 2)} AS b, rank() OVER (PARTITION BY n ORDER BY richest.b DESC, c) AS r FROM richest) WHERE r <= ?", [3])
    return out.select(F.col("n").cast("int").alias("c_nationkey"), F.col("c").alias("c_custkey"), F.col("b").alias("c_acctbal"), F.col("r").cast("long").alias("r"))


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_quantity >= 10 GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Grouping sets over a table that a query defines as a bag."""
    sql = Sql(spark, lambda **_: database(spark, d, "lineitem"))
    query = "{:find [?flag ?status ?part ?supp ?q (count ?p)] :keys [flag status part supp q times] :where [[?l :l_returnflag ?flag] [?l :l_linestatus ?status] [?l :l_quantity ?q] [?l :l_partkey ?part] [?l :l_suppkey ?supp] [?l :l_extendedprice ?p] [(>= ?q 10)]]}"
    sql.create_table("lines", query, {"flag": "varchar", "status": "varchar", "q": "double", "times": "bigint"})
    return sql.sql("SELECT flag AS l_returnflag, status AS l_linestatus, sum(times) AS n, round(sum(q * times), 2) AS q FROM lines GROUP BY CUBE (flag, status)")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of puts of their users' state."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(
        F.col("event_id").cast("long").alias("tx_id"), F.col("ts").alias("tx_time"), F.lit(0).alias("op_idx"), F.lit("put").alias("op"), F.col("user_id").cast("string").alias("eid"),
        F.col("ts").alias("vt"), F.lit(None).cast("timestamp").alias("end_vt"), F.to_json(F.struct("event_type", "event_id")).alias("doc"),
    )


_LAST = "SELECT CAST(user_id AS VARCHAR) AS eid, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


@register(_LAST)
def batch_fold(spark: SparkSession, d: str) -> DataFrame:
    """A whole log folded at once; the current state of each entity."""
    log = event_log(spark, d)
    alive = as_of(fold_log(log), payload=["content_hash"], alive="content_hash")
    docs = documents_of(log).select("content_hash", "doc").dropDuplicates(["content_hash"])
    state = alive.join(docs, "content_hash").select("eid", F.from_json("doc", "event_type string, event_id long").alias("s"))
    return state.select("eid", "s.event_id", "s.event_type")


@register(_LAST)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The same log written to files, tailed as a stream to its end, and read back."""
    root = f"{shared_root(spark)}/tidemark/replay-{uuid.uuid4().hex}"
    event_log(spark, d).write.parquet(f"{root}/log")
    ingest = LogIngest(spark, f"{root}/tables")
    ingest.start(f"{root}/log", available_now=True).awaitTermination()
    state = ingest.current().select("eid", F.from_json("doc", "event_type string, event_id long").alias("s"))
    return state.select("eid", "s.event_id", "s.event_type")


def stored_events(spark: SparkSession, d: str) -> StoredNode:
    """The log of events in stored tables, in two batches."""
    node = StoredNode(spark, f"{shared_root(spark)}/tidemark/stored-{uuid.uuid4().hex}")
    log = event_log(spark, d)
    half = log.agg(F.expr("max(tx_id) div 2")).first()[0]
    node.submit(log.where(F.col("tx_id") <= half))
    node.submit(log.where(F.col("tx_id") > half))
    return node


@register("SELECT event_type, count(*) AS users FROM (SELECT arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND event_id <= (SELECT max(event_id) // 3 FROM events) GROUP BY user_id) GROUP BY event_type")
def stored_asof(spark: SparkSession, d: str) -> DataFrame:
    """A query against stored tables at a valid time, as known at a transaction before the last."""
    node = stored_events(spark, d)
    db = node.db(valid_time=datetime(2024, 1, 15), tx_id=node.latest_completed_tx()["tx_id"] // 3)
    return db.df("{:find [k (count u)] :keys [event_type users] :where [[u :event_type k]] :order-by [[k :asc]]}")


@register("SELECT CAST(user_id AS VARCHAR) AS eid, ts AS vt, event_id AS tx_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def stored_history(spark: SparkSession, d: str) -> DataFrame:
    return history(stored_events(spark, d).ingest.versions(), start=(datetime(2024, 1, 5),), end=(datetime(2024, 1, 20),)).select("eid", "vt", "tx_id")


@register("SELECT CAST(user_id AS VARCHAR) AS eid, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def stored_pull(spark: SparkSession, d: str) -> DataFrame:
    """A pull of all entities of stored tables at a valid time, as one plan."""
    db = stored_events(spark, d).db(valid_time=datetime(2024, 1, 15))
    pulled = pull_columns(db.catalog, db.df("{:find [e] :keys [eid] :where [[e :event_type]]}"), "[:event_id :event_type]")
    return pulled.select("eid", "pulled.event_id", "pulled.event_type")


@register("SELECT event_type, count(*) AS n FROM (SELECT arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND user_id > 20 GROUP BY user_id) GROUP BY event_type")
def sql_temporal_view(spark: SparkSession, d: str) -> DataFrame:
    """A SQL statement with a valid-time prefix over a table that a query of stored tables defines."""
    node = stored_events(spark, d)
    sql = Sql(spark, lambda valid_time=None, tx_time=None, tx_id=None: node.db(valid_time, tx_time, tx_id))
    sql.create_table("user_state", "{:find [?user ?kind] :where [[?user :event_type ?kind] [(long ?user) ?n] [(> ?n 20)]]}", {"?user": "varchar", "?kind": "varchar"})
    return sql.sql("VALIDTIME('2024-01-10') SELECT kind AS event_type, count(*) AS n FROM user_state GROUP BY kind")


@register("""
SELECT user_id AS eid, vt, CASE WHEN vt = TIMESTAMP '2024-02-10' THEN 'base' WHEN vt = TIMESTAMP '2024-02-05' THEN 'trial' ELSE 'base' END AS state
FROM (SELECT DISTINCT user_id FROM events), (VALUES (TIMESTAMP '2024-02-01'), (TIMESTAMP '2024-02-05'), (TIMESTAMP '2024-02-10')) v(vt)""")
def put_range_fold(spark: SparkSession, d: str) -> DataFrame:
    """A put with an end over an open one: the old state comes back at the end."""
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("eid")).distinct()
    put = lambda tx, vt, end, doc: users.select(F.lit(tx).cast("long").alias("tx_id"), F.lit(datetime(2024, 3, 1)).alias("tx_time"), F.lit(0).alias("op_idx"), F.lit("put").alias("op"), "eid", F.lit(vt).cast("timestamp").alias("vt"), F.lit(end).cast("timestamp").alias("end_vt"), F.lit(doc).alias("doc"))
    folded = fold_log(put(1, datetime(2024, 2, 1), None, "base").union(put(2, datetime(2024, 2, 5), datetime(2024, 2, 10), "trial")))
    named = F.when(F.col("content_hash") == F.sha1(F.lit("base").cast("binary")), "base").otherwise("trial")
    return folded.select(F.col("eid").cast("long").alias("eid"), "vt", named.alias("state"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def sparql_filter(spark: SparkSession, d: str) -> DataFrame:
    query, args = translate("""
      SELECT ?c ?name WHERE { ?c <c_name> ?name ; <c_acctbal> ?b ; <c_mktsegment> ?s . FILTER(?b > 5000 && ?s IN ("BUILDING", "MACHINERY"))
        FILTER NOT EXISTS { ?o <o_custkey> ?c ; <o_totalprice> ?t . FILTER(?t > 400000) } }""")
    query.keys = ["c_custkey", "c_name"]
    return database(spark, d, "customer", "orders").df(query, *args)


@register(f"WITH RECURSIVE e AS ({_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r WHERE b < 10")
def sparql_path(spark: SparkSession, d: str) -> DataFrame:
    query, args = translate("SELECT ?a ?b WHERE { ?a <b>+ ?b . FILTER(?b < 10) }")
    return graph(spark, d).df(query, *args)


@register("SELECT n_nationkey AS s, n_name AS o FROM nation")
def ntriples_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as N-Triples lines and parsed again."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    lines = nation.select(F.concat(F.lit("<http://example.org/"), F.col("n_nationkey"), F.lit("> <http://example.org/name> \""), "n_name", F.lit("\" .")).alias("value"))
    return parse_ntriples(lines).select(F.regexp_extract("s", r"(\d+)$", 1).cast("int").alias("s"), "o")


@register("SELECT r_regionkey || ',' || r_name AS value FROM region UNION ALL SELECT 'r_regionkey,r_name'")
def csv_result(spark: SparkSession, d: str) -> DataFrame:
    return as_text(database(spark, d, "region").df("{:find [g name] :keys [r_regionkey r_name] :where [[g :r_name name]]}"), "csv")


@register("SELECT CAST(p_partkey AS VARCHAR) AS eid, CASE WHEN p_partkey % 5 = 0 THEN 'delete' ELSE 'put' END AS op FROM part")
def connect_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a topic as operations: null values delete."""
    part = spark.read.parquet(f"{d}/part.parquet")
    records = part.select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_partkey") % 5 != 0, F.to_json(F.struct("p_name"))).alias("value"))
    return records_to_ops(records).select("eid", "op")


@register("SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY o_orderstatus")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The estimate lies within three standard errors (5 % each) of the exact count."""
    out = database(spark, d, "orders").df("{:find [s (approx-count-distinct c) (count-distinct c)] :keys [o_orderstatus about exact] :where [[o :o_orderstatus s] [o :o_custkey c]]}")
    return out.select("o_orderstatus", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.15 * F.col("exact")).alias("near"))


@register("""
SELECT s_suppkey, s_name, round(total, 2) AS total FROM supplier JOIN (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey) r ON s_suppkey = l_suppkey
WHERE total = (SELECT max(t) FROM (SELECT sum(l_extendedprice * (1 - l_discount)) AS t FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey))""")
def subq_max(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of the largest revenue, all that share it. Sums are of decimals: those of doubles differ by the order of rows, which would part equal ones."""
    totals = """{:find [k (sum r)] :where [[l :l_suppkey k] [l :l_extendedprice p] [l :l_discount disc] [l :l_shipdate ship] [(>= ship #inst "1998-01-01")] [(< ship #inst "1998-04-01")]
                                           [(- 1 disc) keep] [(* p keep) x] [(bigdec x) r]]}"""
    return database(spark, d, "lineitem", "supplier").df(f"""
      {{:find [s name t] :keys [s_suppkey s_name total]
       :where [[(q {totals}) [[s t]]] [(q {{:find [(max y)] :where [[(q {totals}) [[z y]]]]}}) [[t]]] [s :s_name name]]}}""").select("s_suppkey", "s_name", money("total"))


@register("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal >= 1000 AND c_nationkey < 12")
def in_tuple_scalar(spark: SparkSession, d: str) -> DataFrame:
    out = database(spark, d, "customer").df("{:find [c b] :keys [c_custkey c_acctbal] :in [$ [seg least] most] :where [[c :c_mktsegment seg] [c :c_acctbal b] [c :c_nationkey n] [(>= b least)] [(< n most)]]}", ("AUTOMOBILE", 1000), 12)
    return out.select("c_custkey", money("c_acctbal"))


@register("WITH RECURSIVE f(n, x, y) AS (SELECT 0, 0, 1 UNION ALL SELECT n + 1, y, x + y FROM f WHERE n < 12) SELECT p_partkey, CAST(x AS BIGINT) AS f FROM part JOIN f ON n = p_size % 13")
def rule_demand(spark: SparkSession, d: str) -> DataFrame:
    """Computed recursion: the arguments asked for are found first."""
    out = database(spark, d, "part").df("""
      {:find [p f] :keys [p_partkey f] :where [[p :p_size z] [(mod z 13) n] (fib n f)]
       :rules [[(fib [n] f) [(<= n 1)] [(identity n) f]] [(fib [n] f) [(> n 1)] [(- n 1) a] [(- n 2) b] (fib a x) (fib b y) [(+ x y) f]]]}""")
    return out.select("p_partkey", F.col("f").cast("long").alias("f"))


@register("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_returnflag = 'R')")
def subq_exists(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "supplier", "lineitem").df("""
      {:find [s] :keys [s_suppkey] :where [[s :s_name] [(q {:find [l] :in [s] :where [[x :l_suppkey s] [x :l_quantity l] [x :l_returnflag "R"] [(>= l 50)]]} s)]]}""")


@register("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def subq_top_per_key(spark: SparkSession, d: str) -> DataFrame:
    """A correlated sub-query that orders and limits: the limit holds for each outer value."""
    return database(spark, d, "orders", "customer").df("""
      {:find [c o t] :keys [o_custkey o_orderkey o_totalprice]
       :where [[c :c_name] [(q {:find [x p] :in [c] :where [[x :o_custkey c] [x :o_totalprice p]] :order-by [[p :desc] [x :asc]] :limit 2} c) [[o t]]]]}""").select("o_custkey", "o_orderkey", money("o_totalprice"))


@register("SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS squares FROM lineitem GROUP BY l_returnflag")
def agg_custom(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of the user's own."""
    db = database(spark, d, "lineitem")
    db.aggregates["sum-of-squares"] = lambda x: F.sum(x * x)
    return db.df("{:find [f (sum-of-squares q)] :keys [l_returnflag squares] :where [[l :l_returnflag f] [l :l_quantity q]]}").select("l_returnflag", money("squares"))


@register("SELECT p_partkey, 'B-' || substr(p_brand, 7) AS code FROM part")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    """A function of the user's own, by name and on the allow-list."""
    db = database(spark, d, "part")
    db.functions["shop/code"] = lambda brand: F.concat(F.lit("B-"), F.substring(brand, 7, 100))
    db.allowed = {"shop"}
    return db.df("{:find [p code] :keys [p_partkey code] :where [[p :p_brand b] [(shop/code b) code]]}")


@register("SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d, "customer", "supplier", "nation").df("""
      {:find [n] :where [[c :c_nationkey n] [c :c_acctbal b] [(> b 9000)] [s :s_nationkey n] (not [n :n_regionkey 0])]}""")


@register("SELECT user_id, count(*) AS n, CAST(floor(max(CAST(json_extract(props, '$.k') AS DOUBLE))) AS BIGINT) AS most FROM events WHERE event_type = 'click' GROUP BY user_id")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Values inside JSON text, by a registered function."""
    db = database(spark, d, "events")
    db.functions["json/long"] = lambda text, path: F.get_json_object(text, path).cast("long")
    return db.df('{:find [u (count e) (max k)] :keys [user_id n most] :where [[e :event_type "click"] [e :user_id u] [e :props p] [(json/long p "$.k") k]]}')


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows over the events as a stream, read to its end into a table."""
    root = f"{shared_root(spark)}/tidemark/hours-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{root}/in")
    hours = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    query = hours.writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("window.start").alias("start"), "event_type", "n", money("total", 3))


# Function families: what each call gives for every part (n its name, b brand, t type, z size, m 20 - z, w the words of its name), beside SQL for the same.

_PARTS = "(SELECT p_partkey AS p, p_name AS n, p_brand AS b, p_type AS t, p_size AS z, 20 - p_size AS m, string_split(p_name, ' ') AS w FROM part)"

FAMILIES = {
    "fn_numbers": [
        ("inc", "(inc z)", "z + 1"), ("dec", "(dec z)", "z - 1"), ("neg", "(- z)", "-z"), ("abs", "(abs m)", "abs(m)"), ("sum", "(+ z p 1)", "z + p + 1"), ("product", "(* z 3 m)", "z * 3 * m"),
        ("quotient", "(/ z 4)", "z / 4"), ("quot", "(quot m 7)", "CAST(trunc(m / 7) AS BIGINT)"), ("rem", "(rem m 7)", "m % 7"), ("mod", "(mod m 7)", "(m % 7 + 7) % 7"), ("least", "(min z 25 p)", "least(z, 25, p)"), ("most", "(max z m)", "greatest(z, m)"),
        ("big_sum", "(+' z 9000000000)", "z + 9000000000"), ("big_inc", "(inc' z)", "z + 1"), ("big_dec", "(dec' z)", "z - 1"), ("big_product", "(*' z 3)", "z * 3"), ("big_rest", "(-' z 3)", "z - 3"),
    ],
    "fn_comparisons": [
        ("lt", "(< m z)", "m < z"), ("le", "(<= 10 z 20)", "10 <= z AND z <= 20"), ("gt", "(> z 10 m)", "z > 10 AND 10 > m"), ("ge", "(>= z 25)", "z >= 25"), ("eq", "(= z 25)", "z = 25"), ("same", "(== z m)", "z = m"), ("ne", "(not= z m)", "z <> m"), ("differs", "(!= z 25)", "z <> 25"),
        ("ordered", "(compare z 25)", "CASE WHEN z < 25 THEN -1 WHEN z > 25 THEN 1 ELSE 0 END"), ("text_order", '(compare b "Brand#3")', "CASE WHEN b < 'Brand#3' THEN -1 WHEN b > 'Brand#3' THEN 1 ELSE 0 END"), ("all_differ", "(distinct? z m 10)", "z <> m AND z <> 10 AND m <> 10"), ("identical", "(identical? b b)", "true"),
    ],
    "fn_bits": [
        ("b_and", "(bit-and z 12)", "z & 12"), ("b_or", "(bit-or z 3)", "z | 3"), ("b_xor", "(bit-xor z 5)", "xor(z, 5)"), ("b_not", "(bit-not z)", "~z"), ("b_and_not", "(bit-and-not z 6)", "z & ~6"), ("shl", "(bit-shift-left z 2)", "z << 2"), ("shr", "(bit-shift-right z 1)", "z >> 1"),
        ("ushr", "(unsigned-bit-shift-right z 2)", "z >> 2"), ("b_set", "(bit-set z 4)", "z | 16"), ("b_clear", "(bit-clear z 1)", "z & ~2"), ("b_flip", "(bit-flip z 0)", "xor(z, 1)"), ("b_test", "(bit-test z 2)", "(z & 4) <> 0"),
    ],
    "fn_tests": [
        ("even", "(even? z)", "z % 2 = 0"), ("odd", "(odd? m)", "m % 2 <> 0"), ("pos", "(pos? m)", "m > 0"), ("neg", "(neg? m)", "m < 0"), ("zero", "(zero? m)", "m = 0"), ("pos_int", "(pos-int? m)", "m > 0"), ("neg_int", "(neg-int? m)", "m < 0"), ("nat_int", "(nat-int? m)", "m >= 0"),
        ("is_nil", "(nil? n)", "n IS NULL"), ("is_some", "(some? n)", "n IS NOT NULL"), ("is_any", "(any? n)", "true"), ("is_number", "(number? z)", "true"), ("text_number", "(number? n)", "false"), ("is_int", "(int? z)", "true"), ("is_double", "(double? z)", "false"), ("is_string", "(string? b)", "true"),
        ("is_keyword", "(keyword? b)", "false"), ("is_coll", "(coll? w)", "true"), ("is_vector", "(vector? w)", "true"), ("is_map", "(map? w)", "false"), ("is_uuid", "(uuid? n)", "false"), ("is_uri", "(uri? n)", "false"), ("is_blank", "(blank? n)", "trim(n) = ''"), ("is_empty", "(empty? w)", "len(w) = 0"),
    ],
    "fn_text": [
        ("up", "(upper-case n)", "upper(n)"), ("low", "(lower-case t)", "lower(t)"), ("cap", "(capitalize n)", "upper(n[1:1]) || lower(n[2:])"), ("tail", "(subs n 2)", "substr(n, 3)"), ("part", "(subs n 1 4)", "substr(n, 2, 3)"), ("glued", '(str b "-" z)', "b || '-' || z"), ("shaped", '(format "%s/%03d" b z)', "printf('%s/%03d', b, z)"),
        ("found", '(re-find "[A-Z]+$" t)', "nullif(regexp_extract(t, '[A-Z]+$'), '')"), ("whole", '(re-matches "Brand#1." b)', "CASE WHEN regexp_full_match(b, 'Brand#1.') THEN b END"), ("every", '(re-seq "[a-e]+" n)', "to_json(regexp_extract_all(n, '[a-e]+'))"), ("starts", '(starts-with? b "Brand#1")', "starts_with(b, 'Brand#1')"), ("ends", '(ends-with? b "3")', "ends_with(b, '3')"),
        ("holds", '(includes? n "re")', "contains(n, 're')"), ("at", '(index-of n "e")', "nullif(instr(n, 'e') - 1, -1)"), ("size", "(string-length n)", "length(n)"), ("back", "(string-reverse b)", "reverse(b)"), ("swapped", '(replace n "e" "_")', "replace(n, 'e', '_')"), ("joined", '(join "+" w)', "array_to_string(w, '+')"), ("trimmed", "(trim b)", "trim(b)"), ("left_trimmed", "(triml b)", "ltrim(b)"), ("right_trimmed", "(trimr b)", "rtrim(b)"),
    ],
    "fn_sequences": [
        ("head", "(first w)", "w[1]"), ("two", "(second w)", "w[2]"), ("end", "(last w)", "w[-1]"), ("top", "(peek w)", "w[-1]"), ("some", "(nth w 0)", "w[1]"), ("size", "(size w)", "len(w)"), ("rest", "(rest w)", "to_json(w[2:])"), ("init", "(butlast w)", "to_json(w[:-2])"), ("popped", "(pop w)", "to_json(w[:-2])"), ("some_first", "(take 2 w)", "to_json(w[1:2])"), ("dropped", "(drop 1 w)", "to_json(w[2:])"),
        ("some_last", "(take-last 2 w)", "to_json(w[-2:])"), ("back", "(reverse w)", "to_json(list_reverse(w))"), ("sorted", "(sort w)", "to_json(list_sort(w))"), ("added", "(conj w \"x\")", "to_json(list_append(w, 'x'))"), ("led", '(cons "x" w)', "to_json(list_prepend('x', w))"), ("twice", "(concat w w)", "to_json(list_concat(w, w))"), ("few", "(subvec w 0 2)", "to_json(w[1:2])"), ("numbers", "(range 0 3)", "'[0,1,2]'"), ("many", "(repeat 2 b)", "to_json([b, b])"),
        ("given", "(vector z m)", "to_json([z, m])"), ("listed", "(list z m)", "to_json([z, m])"), ("nths", "(take-nth 2 w)", "to_json(list_filter(w, lambda x, i: i % 2 = 1))"), ("spaced", '(interpose "-" w)', "to_json(list_filter(flatten(list_transform(w, lambda x: ['-', x])), lambda x, i: i > 1))"),
    ],
    "fn_sets_maps": [
        ("made", "(hash-set z z)", "to_json([z])"), ("ordered", "(sorted-set z 25 3)", "to_json(list_sort(list_distinct([z, 25, 3])))"), ("held", '(contains? w "red")', "list_contains(w, 'red')"), ("among", "(contains? #{1 7 30} z)", "z IN (1, 7, 30)"), ("size_u", "(vector z) u (vector m) v (union u v) x (size x)", "CASE WHEN z = m THEN 1 ELSE 2 END"),
        ("both", "(vector z 10) u1 (vector m 10) v1 (intersection u1 v1) x1 (sort x1)", "to_json(list_sort(CASE WHEN z = m AND z <> 10 THEN [z, 10] ELSE [10] END))"), ("less", "(vector z 10) u2 (vector 10) v2 (difference u2 v2)", "to_json(list_filter([z, 10], lambda x: x <> 10))"), ("without", "(vector z 10 11) u3 (disj u3 10)", "to_json(list_filter([z, 10, 11], lambda x: x <> 10))"),
        ("got", '(hash-map "a" z "b" m) h (get h "b")', "m"), ("missing", '(hash-map "a" z) h1 (get h1 "c" 7)', "7"), ("names", '(hash-map "a" z "b" m) h2 (keys h2)', "'[\"a\",\"b\"]'"), ("values", '(hash-map "a" z "b" m) h3 (vals h3)', "to_json([z, m])"), ("put", '(hash-map "a" z) h4 (assoc h4 "a" m) h5 (get h5 "a")', "m"), ("gone", '(hash-map "a" z "b" m) h6 (dissoc h6 "a") h7 (keys h7)', "'[\"b\"]'"),
        ("merged", '(hash-map "a" z) h8 (hash-map "a" m) h9 (merge h8 h9) h10 (get h10 "a")', "m"), ("paired", '(vector b t) kk (vector z m) vv (zipmap kk vv) h11 (get h11 t)', "m"),
    ],
    "fn_casts": [
        ("as_long", "(long z)", "CAST(z AS BIGINT)"), ("as_int", "(int p)", "CAST(p AS INTEGER)"), ("as_short", "(short z)", "CAST(z AS SMALLINT)"), ("as_byte", "(byte z)", "CAST(z AS TINYINT)"), ("as_double", "(double z)", "CAST(z AS DOUBLE)"), ("as_keyword", "(keyword b)", "':' || b"), ("as_name", '(name ":shop/part")', "'part'"), ("as_space", '(namespace ":shop/part")', "'shop'"),
        ("as_text", "(str z)", "CAST(z AS VARCHAR)"), ("as_same", "(identity z)", "z"), ("as_not", "(even? z) ev (not ev)", "z % 2 <> 0"), ("as_true", "(even? z) ev1 (true? ev1)", "z % 2 = 0"), ("as_false", "(even? z) ev2 (false? ev2)", "z % 2 <> 0"),
    ],
}


def _family(name: str) -> None:
    calls, columns = [], []
    for column, steps, _ in FAMILIES[name]:
        parts = re.findall(r"(\((?:[^()\"]|\"[^\"]*\")*\))(?: (\w+))?", steps)
        calls += [f"[{call} {var or 'out_' + column}]" for call, var in parts]
        columns.append(column)
    query = f"{{:find [p {' '.join('out_' + x for x in columns)}] :keys [p_partkey {' '.join(columns)}] :where [[p :p_name n] [p :p_brand b] [p :p_type t] [p :p_size z] [(- 20 z) m] [(split n \" \") w] {' '.join(calls)}]}}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = database(spark, d, "part").df(query)
        return out.select(*[F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in out.dtypes])

    run.__name__ = name
    register(f"SELECT p AS p_partkey, {', '.join(f'{sql} AS {column}' for column, _, sql in FAMILIES[name])} FROM {_PARTS}")(run)


for _name in FAMILIES:
    _family(_name)
