"""The SQL surface: tables defined by queries, read at a basis that prefixes of the statement may choose."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.db import Db
from tidemark.edn import instant

TYPES = {"boolean": "boolean", "bigint": "bigint", "double": "double", "float": "float", "timestamp": "timestamp", "varchar": "string", "decimal": "decimal(38,18)", "keyword": "string", "uuid": "string"}
_PREFIX = re.compile(r"\s*(VALIDTIME|TRANSACTIONTIME|TRANSACTIONID)\s*\(\s*(?:'([^']*)'|(\d+))\s*\)", re.I)
_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION truncate(x DOUBLE, n INT DEFAULT 0) RETURNS DOUBLE RETURN sign(x) * floor(abs(x) * pow(10, n)) / pow(10, n)",
    "CREATE OR REPLACE TEMPORARY FUNCTION keyword(x STRING) RETURNS STRING RETURN concat(':', x)",
)


@dataclass
class SqlTable:
    name: str
    query: object
    columns: dict[str, str]


def strip_comments(sql: str) -> str:
    return re.sub(r"('(?:[^']|'')*')|--[^\n]*", lambda m: m[1] or "", sql)


def split_prefixes(sql: str) -> tuple[dict[str, object], str]:
    """The basis named before a statement, and the statement."""
    basis: dict[str, object] = {}
    while m := _PREFIX.match(sql):
        kind, text, number = m[1].upper(), m[2], m[3]
        if kind == "TRANSACTIONID":
            basis["tx_id"] = int(number if number is not None else text)
        else:
            basis["valid_time" if kind == "VALIDTIME" else "tx_time"] = instant(text).astimezone(timezone.utc).replace(tzinfo=None)
        sql = sql[m.end() :]
    return basis, sql


def rewrite(sql: str) -> str:
    """{fn F(...)} escapes, UUID literals, EXPLAIN PLAN FOR."""
    sql = re.sub(r"\{\s*fn\s+((?:[^{}']|'(?:[^']|'')*')*)\}", r"\1", sql, flags=re.I)
    sql = re.sub(r"\bUUID\s*\(\s*('(?:[^']|'')*')\s*\)", r"lower(\1)", sql, flags=re.I)
    return re.sub(r"^\s*EXPLAIN\s+PLAN\s+FOR\b", "EXPLAIN", sql, flags=re.I)


class Sql:
    """db_at(valid_time=, tx_time=, tx_id=) gives the database at a basis."""

    def __init__(self, spark: SparkSession, db_at: Callable[..., Db]) -> None:
        self.spark, self.db_at = spark, db_at
        self.tables: dict[str, SqlTable] = {}
        for statement in _FUNCTIONS:
            spark.sql(statement)

    def create_table(self, name: str, query: object, columns: dict[str, str]) -> None:
        """A table of the query's variables (without a leading `?`) with declared types."""
        for column, kind in columns.items():
            if kind.lower() not in TYPES:
                raise ValueError(f"column {column} has the unknown type {kind}")
        self.tables[name.lower()] = SqlTable(name, query, {k.lstrip("?").lower(): v.lower() for k, v in columns.items()})

    def _view(self, table: SqlTable, db: Db) -> DataFrame:
        from tidemark.plans.parse import parse

        query = parse(table.query)
        df = db.df(query)
        names = {c.lstrip("?").lower(): c for c in df.columns}
        if unknown := set(table.columns) - set(names):
            raise ValueError(f"table {table.name} has no columns {sorted(unknown)}")
        return df.selectExpr(*[f"CAST(`{names[c]}` AS {TYPES[kind]}) AS `{c}`" for c, kind in table.columns.items()])

    def sql(self, statement: str, args: list | None = None) -> DataFrame:
        """The statement's rows; VALIDTIME('...'), TRANSACTIONTIME('...') and TRANSACTIONID(n) before it choose the basis; ? are parameters."""
        basis, rest = split_prefixes(strip_comments(statement))
        used = [t for name, t in self.tables.items() if re.search(rf"\b{re.escape(name)}\b", rest, re.I)]
        db = self.db_at(**basis) if used else None
        for t in used:
            self._view(t, db).createOrReplaceTempView(t.name)
        return self.spark.sql(rewrite(rest), args=args or None)


def catalog_sql(db: Db) -> Sql:
    """SQL over a fixed database: every entity table is a view as it is."""
    out = Sql(db.spark, lambda **_: db)
    for t in db.catalog.tables.values():
        t.df.createOrReplaceTempView(t.name)
    return out


def utc(text: str) -> datetime:
    return instant(text)
