"""Clauses to one DataFrame with a column for each variable.

All triples of one entity variable in one table are a single scan. Scans are joined along shared
variables: what is looked up by its id first, then what refers to an id that is bound, what shares
other values last, as only that multiplies both sides. Predicates, ranges and function bindings are applied as soon as
their variables are bound; Catalyst pushes them down. `not` is an anti-join, `or` a union, a
correlated sub-query a join with the distinct values it depends on, a rule a relation that a
fixpoint fills. Every row is one distinct assignment of all variables, so aggregates see a bag.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.edn import Call, Keyword, Symbol
from tidemark.functions.aggregates import aggregate, keeps_some, some_values
from tidemark.functions.scalar import c, resolve, truthy
from tidemark.model import Catalog, EntityTable
from tidemark.plans.parse import Not, Or, Pred, Query, Rule, RuleCall, Triple, binding_names, fresh, is_var, parse, variables

RANGE_OPS: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


class Unbound(Exception):
    """A clause needs variables that nothing binds."""

    def __init__(self, names: set[str]) -> None:
        super().__init__(f"nothing binds {sorted(names)}")
        self.names = names


def literal(value: object) -> object:
    """A query's literal as the Python value that columns hold."""
    if isinstance(value, Keyword):
        return repr(value)
    if isinstance(value, uuid.UUID):
        return str(value)
    if isinstance(value, Fraction):
        return float(value)
    return value


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.NullType):
        return "any"
    return kind.typeName()


def _matches(value: object, kind: T.DataType) -> bool:
    """Whether a literal can equal a value of the column's type; if not, nothing does."""
    family = _family(kind)
    if value is None or family == "any":
        return True
    if isinstance(value, bool):
        return family == "boolean"
    if isinstance(value, (int, float, Decimal)):
        return family == "number"
    if isinstance(value, (dt.datetime, dt.date)):
        return family == "time"
    if isinstance(value, str):
        return family in ("string", "time")
    return True


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, rules: list[Rule] | None = None, functions: dict[str, Callable] | None = None, aggregates: dict[str, Callable] | None = None, allowed: set[str] | None = None, constraints: dict[str, Callable] | None = None, nullsafe: bool = False, most_rounds: int | None = None) -> None:
        self.spark, self.catalog = spark, catalog
        self.rules: dict[str, list[Rule]] = {}
        for r in rules or []:
            self.rules.setdefault(r.name, []).append(r)
        self.functions, self.aggregates, self.allowed = functions or {}, aggregates or {}, allowed
        self.constraints = constraints or {}
        self.nullsafe, self.most_rounds = nullsafe, most_rounds
        self.relations: dict[str, DataFrame] = {}
        self.units: list[DataFrame] = []

    # Joins.

    def _aligned(self, a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        for name in on:
            x, y = a.schema[name].dataType, b.schema[name].dataType
            if x == y:
                continue
            if _family(x) == _family(y) == "number" or "any" in (_family(x), _family(y)) or _family(x) == _family(y) == "time":
                continue
            a, b = a.withColumn(name, F.col(name).cast("string")), b.withColumn(name, F.col(name).cast("string"))
        return a, b

    def join(self, a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        if how == "inner" and any(a is u for u in self.units):
            return b
        on = [x for x in a.columns if x in b.columns]
        if not on:
            if how == "inner":
                return a.crossJoin(b)
            return a.join(b.limit(1).select(F.lit(1).alias(fresh("__unit"))), F.lit(True), how)
        a, b = self._aligned(a, b, on)
        if not self.nullsafe:
            return a.join(b, on, how)
        renamed = b.select([F.col(f"`{x}`").alias(f"{x}__r" if x in on else x) for x in b.columns])
        cond = F.lit(True)
        for x in on:
            cond = cond & F.col(f"`{x}`").eqNullSafe(F.col(f"`{x}__r`"))
        return a.join(renamed, cond, how).drop(*[f"{x}__r" for x in on])

    # Scans.

    def _scan(self, table: EntityTable, e: object, parts: list[tuple[str, object]]) -> DataFrame:
        """One scan for all triples of an entity in a table: variables as columns, literals as filters."""
        df, keep, seen = table.df, {}, {}
        exploded = []
        filters: list[Column] = []

        def bind(name: str, column: Column) -> None:
            if name in keep:
                filters.append(keep[name].eqNullSafe(column))
            else:
                keep[name] = column

        if is_var(e):
            if table.eid is not None:
                bind(e.name, F.col(f"`{table.eid}`"))
        elif e is None:
            filters.append(F.lit(False))
        else:
            filters.append(self._equals(F.col(f"`{table.column('_id')}`"), e, table.kind("_id")))
        for attribute, v in parts:
            name, kind = table.column(attribute), table.kind(attribute)
            column = F.col(f"`{name}`")
            if isinstance(kind, T.ArrayType):
                alias = f"{fresh('__x')}"
                exploded.append((alias, name))
                column, kind = F.col(f"`{alias}`"), kind.elementType
            else:
                present = table.present(attribute)
                if attribute != "_id" or table.nils is not None:
                    filters.append(present)
            if is_var(v):
                bind(v.name, column)
            elif v is None:
                filters.append(column.isNull())
            else:
                filters.append(self._equals(column, v, kind))
            seen[attribute] = True
        for alias, name in exploded:
            df = df.withColumn(alias, F.explode(F.array_distinct(f"`{name}`")))
        for cond in filters:
            df = df.where(cond)
        return df.select([col.alias(name) for name, col in keep.items()]) if keep else df.select(F.lit(1).alias(fresh("__held")))

    def _equals(self, column: Column, value: object, kind: T.DataType) -> Column:
        if isinstance(value, (set, frozenset)):
            some = [literal(v) for v in value]
            some = [v for v in some if _matches(v, kind)]
            return column.isin(some) if some else F.lit(False)
        value = literal(value)
        return column == F.lit(value) if _matches(value, kind) else F.lit(False)

    def _star(self, e: object, parts: list[tuple[str, object]]) -> list[DataFrame]:
        """Relations of all triples with one entity: a union over the tables that have all attributes, or one for each attribute."""
        tables = self.catalog.holding({a for a, _ in parts})
        if tables:
            made = [self._scan(t, e, parts) for t in tables]
            out = made[0]
            for more in made[1:]:
                if set(more.columns) == set(out.columns):
                    a, b = self._aligned(out, more, out.columns)
                    out = a.unionByName(b)
            return [out]
        if len(parts) == 1:
            names = [x.name for x in (e, parts[0][1]) if is_var(x)] or [fresh("__held")]
            return [self.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)]))]
        return [df for part in parts for df in self._star(e, [part])]

    # Clauses.

    def solve(self, clauses: list, seed: DataFrame | None = None, rules: dict[str, DataFrame] | None = None) -> DataFrame:
        """The relation of all assignments that satisfy the clauses, joined with `seed`."""
        stars: dict[object, list[tuple[str, object]]] = {}
        rest, relations, ids = [], [], set()
        for x in clauses:
            if isinstance(x, Triple):
                key = x.e if is_var(x.e) or x.e is None or not isinstance(x.e, list) else tuple(x.e)
                stars.setdefault(key, []).append((x.a, x.v))
            else:
                rest.append(x)
        for e, parts in stars.items():
            relations += [(e.name if is_var(e) else None, r) for r in self._star(e, parts)]
        out = seed
        while relations or rest:
            if out is not None:
                done = [x for x in rest if self._ready(x, set(out.columns))]
                if done:
                    first = min(done, key=self._rank)
                    rest.remove(first)
                    out = self._apply(first, out, rules)
                    continue
            if relations:
                bound = set(out.columns) if out is not None else set()
                at = min(range(len(relations)), key=lambda k: self._growth(*relations[k], bound, ids))
                if out is not None and not bound & set(relations[at][1].columns):
                    # Nothing connects yet: a rule, an or or a function may, before a cross product does.
                    link = next((x for x in rest if self._can_start(x) and variables(x) & (bound | {n for _, r in relations for n in r.columns})), None)
                    if link is not None:
                        rest.remove(link)
                        out = self._apply(link, out, rules)
                        continue
                key, one = relations.pop(at)
                ids.add(key)
                out = one if out is None else self.join(out, one)
                continue
            start = next((x for x in rest if self._can_start(x)), None)
            if start is None:
                unit = self._unit()
                if out is None and any(self._ready(x, set()) for x in rest):
                    out = unit
                    continue
                raise Unbound(set().union(*(self._needs(x) for x in rest)) - (set(out.columns) if out is not None else set()))
            rest.remove(start)
            out = self._apply(start, out, rules)
        return out if out is not None else self._unit()

    @staticmethod
    def _growth(key: str | None, relation: DataFrame, bound: set[str], ids: set[str | None]) -> tuple[int, int]:
        """How a join with a relation of entities `key` may grow what is bound: not at all by its id, by its rows for an id of those joined before (`ids`), by a product of both sides along other values."""
        shared = bound & set(relation.columns)
        return (3 if not shared else 0 if key in shared else 1 if shared & ids else 2), -len(shared)

    def _unit(self) -> DataFrame:
        """One row without variables; joined as it is, it leaves the other side alone."""
        self.units.append(self.spark.range(1).select(F.lit(1).alias(fresh("__unit"))))
        return self.units[-1]

    def _rank(self, x: object) -> int:
        return 0 if isinstance(x, Pred) and x.binding is None else 1 if isinstance(x, Pred) else 2 if isinstance(x, Not) else 3

    def _needs(self, x: object) -> set[str]:
        """Variables that must be bound before a clause can be applied."""
        if isinstance(x, Pred):
            out = {a.name for a in x.args if is_var(a) and a.name != "$"}
            for a in x.args:
                if isinstance(a, Call):
                    out |= {y.name for y in a[1:] if is_var(y)}
            return out
        if isinstance(x, Not):
            return variables(x)
        if isinstance(x, Or):
            own = self._self_bound(x)
            return set(x.bound) | {n for b in x.branches for y in b for n in self._needs(y) if not isinstance(y, (Or, RuleCall))} - own if not own else set(x.bound) | self._open(x)
        if isinstance(x, RuleCall):
            heads = self.heads(x)
            return {a.name for a, b in zip(x.args, heads[0].args, strict=False) if is_var(a) and b in heads[0].bound}
        return set()

    def heads(self, x: RuleCall) -> list[Rule]:
        name = x.name.removeprefix("Δ")
        if name not in self.rules:
            raise ValueError(f"unknown rule {name}")
        return self.rules[name]

    def _self_bound(self, x: Or) -> set[str]:
        return set().union(*(self._binds(b) for b in x.branches))

    def _binds(self, clauses: list) -> set[str]:
        out: set[str] = set()
        for y in clauses:
            if isinstance(y, (Triple, RuleCall)):
                out |= variables(y)
            elif isinstance(y, Pred):
                out |= set(binding_names(y.binding))
            elif isinstance(y, Or):
                out |= self._self_bound(y)
        return out

    def _open(self, x: Or) -> set[str]:
        """Variables that some branch needs from outside."""
        out: set[str] = set()
        for b in x.branches:
            own = self._binds(b)
            for y in b:
                out |= (self._needs(y) if not isinstance(y, Not) else variables(y)) - own
        return out

    def _ready(self, x: object, bound: set[str]) -> bool:
        if isinstance(x, Pred) and is_var(x.fn) and x.fn.name == "q" and not x.args[1:]:
            return True
        return self._needs(x) <= bound

    def _can_start(self, x: object) -> bool:
        return not isinstance(x, Not) and not self._needs(x)

    def _apply(self, x: object, out: DataFrame | None, rules: dict[str, DataFrame] | None) -> DataFrame:
        if isinstance(x, Pred):
            return self._pred(x, out if out is not None else self._unit(), rules)
        if isinstance(x, Not):
            return self._not(x, out, rules)
        if isinstance(x, Or):
            return self._or(x, out, rules)
        return self._rule(x, out, rules)

    # Predicates and functions.

    def _arg(self, x: object, df: DataFrame) -> object:
        if is_var(x):
            if x.name not in df.columns:
                raise Unbound({x.name})
            return F.col(f"`{x.name}`")
        if isinstance(x, Call):
            return self.call(x[0], list(x[1:]), df)
        if isinstance(x, (list, tuple)):
            return [self._arg(v, df) for v in x]
        if isinstance(x, dict):
            return {literal(k): self._arg(v, df) for k, v in x.items()}
        if isinstance(x, (set, frozenset)):
            return frozenset(literal(v) for v in x)
        return literal(x)

    def call(self, fn: object, args: list, df: DataFrame) -> Column:
        name = fn.name if isinstance(fn, (Symbol, Keyword)) else str(fn)
        make = fn if callable(fn) else resolve(name, self.allowed, self.functions)
        values = [self._arg(a, df) for a in args]
        if getattr(make, "typed", False) and is_var(args[0]):
            return make(values[0], df.schema[args[0].name].dataType)
        if name in ("count", "empty?", "first", "last", "get", "reverse") and is_var(args[0]):
            kind = df.schema[args[0].name].dataType
            if name == "count" and isinstance(kind, (T.ArrayType, T.MapType)):
                return F.coalesce(F.size(values[0]), F.lit(0))
            if name == "empty?" and isinstance(kind, T.StringType):
                return F.coalesce(F.length(values[0]) == 0, F.lit(True))
        return make(*values)

    def _pred(self, x: Pred, df: DataFrame, rules: dict[str, DataFrame] | None) -> DataFrame:
        name = x.fn.name if is_var(x.fn) else ""
        if name == "q":
            return self._subquery(x, df)
        if name == "get-attr":
            return self._get_attr(x, df)
        if name in self.constraints:
            return self.join(df, self.constraints[name](self, x, df)) if set(df.columns) - {n for n in df.columns if n.startswith("__unit")} else self.constraints[name](self, x, df)
        if x.binding is None and name in ("==", "!="):
            return df.where(self._unify(name, x.args, df))
        if x.binding is None and name in RANGE_OPS and len(x.args) == 2:
            return df.where(self._range(name, x.args, df))
        value = self.call(x.fn, x.args, df)
        if x.binding is None:
            return df.where(self._test(c(value), df))
        return self._bind(df, c(value), x.binding)

    def _range(self, op: str, args: list, df: DataFrame) -> Column:
        """A comparison that scans can take; values of different kinds never compare."""
        a, b = (self._arg(x, df) for x in args)
        kinds = [df.schema[x.name].dataType if is_var(x) else None for x in args]
        for k, other in ((0, b), (1, a)):
            if kinds[k] is not None and kinds[1 - k] is None and not isinstance(other, Column) and not _matches(other, kinds[k]):
                return F.lit(False)
        if all(k is not None for k in kinds):
            families = [_family(k) for k in kinds]
            if families[0] != families[1] and "any" not in families:
                return F.lit(False)
        a, b = self._day(a, kinds[1]), self._day(b, kinds[0])
        return RANGE_OPS[op](c(a), c(b))

    @staticmethod
    def _day(value: object, other: T.DataType | None) -> object:
        """A literal midnight as a date beside a date column, which then needs no cast."""
        if isinstance(other, T.DateType) and isinstance(value, dt.datetime):
            plain = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
            if plain.time() == dt.time(0):
                return plain.date()
        return value

    def _unify(self, op: str, args: list, df: DataFrame) -> Column:
        def values(x: object) -> Column | list:
            return [literal(v) for v in x] if isinstance(x, (set, frozenset)) else self._arg(x, df)

        a, b = (values(x) for x in args)
        if isinstance(a, list) and isinstance(b, list):
            same = F.lit(bool(set(a) & set(b)))
        elif isinstance(b, list) or isinstance(a, list):
            one, many, term = (a, b, args[0]) if isinstance(b, list) else (b, a, args[1])
            kind = df.schema[term.name].dataType if is_var(term) else None
            many = [v for v in many if kind is None or _matches(v, kind)]
            same = F.coalesce(c(one).isin(many), F.lit(False)) if many else F.lit(False)
        else:
            for x, y, other in ((args[0], args[1], b), (args[1], args[0], a)):
                if is_var(x) and not is_var(y) and not isinstance(y, Call) and not _matches(other, df.schema[x.name].dataType):
                    return F.lit(op == "!=")
            same = c(a).eqNullSafe(c(b))
        return same if op == "==" else ~same

    def _bind(self, df: DataFrame, value: Column, binding: tuple[str, object]) -> DataFrame:
        shape, names = binding
        if shape == "scalar":
            return self._set(df, names, value)
        if shape == "collection":
            column = fresh("__c")
            kind = df.select(value.alias("v")).schema[0].dataType
            many = F.array_distinct(value) if isinstance(kind, T.ArrayType) else F.array(value)
            return self._set(df.withColumn(column, F.explode(many)), names, F.col(column)).drop(column)
        if shape == "tuple":
            column = fresh("__t")
            df = df.withColumn(column, value)
            kind = df.schema[column].dataType
            for k, name in enumerate(names):
                one = F.col(column).getField(kind.fieldNames()[k]) if isinstance(kind, T.StructType) else F.get(F.col(column), F.lit(k))
                df = self._set(df, name, one)
            return df.drop(column)
        column = fresh("__r")
        df = df.withColumn(column, F.explode(F.array_distinct(value)))
        kind = df.schema[column].dataType
        for k, name in enumerate(names):
            one = F.col(column).getField(kind.fieldNames()[k]) if isinstance(kind, T.StructType) else F.get(F.col(column), F.lit(k))
            df = self._set(df, name, one)
        return df.drop(column)

    def _set(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """Bind a variable, or keep the rows where it has that value already."""
        return df.where(F.col(f"`{name}`").eqNullSafe(value)) if name in df.columns else df.withColumn(name, value)

    def _get_attr(self, x: Pred, df: DataFrame) -> DataFrame:
        e, attribute = x.args[0], x.args[1].name if isinstance(x.args[1], Keyword) else str(x.args[1])
        default = x.args[2] if len(x.args) > 2 else None
        key = e.name if is_var(e) else fresh("__e")
        if not is_var(e):
            df = df.withColumn(key, c(literal(e)))
        value = fresh("__v")
        facts = self._star(Symbol(key), [(attribute, Symbol(value))])[0]
        if x.binding is None:
            return self.join(df, facts.select(key).distinct(), "left_semi")
        shape = x.binding[0]
        if shape == "collection" and default is None:
            return self._set(self.join(df, facts), x.binding[1], F.col(value)).drop(value)
        if shape == "collection":
            out = self.join(df, facts, "left")
            return self._set(out, x.binding[1], F.coalesce(F.col(value), c(literal(default)))).drop(value)
        listed = facts.groupBy(key).agg(F.collect_set(value).alias(value))
        out = self.join(df, listed, "left")
        if default is not None:
            out = out.withColumn(value, F.coalesce(value, F.array(c(literal(default)))))
        if shape == "scalar":
            return self._set(out, x.binding[1], F.col(value)).drop(value)
        return self._bind(out, F.col(value), x.binding).drop(value)

    # Sub-queries.

    def _subquery(self, x: Pred, df: DataFrame) -> DataFrame:
        inner = parse(x.args[0])
        inner.rules = inner.rules or [r for rs in self.rules.values() for r in rs]
        args = x.args[1:]
        args = args[1:] if args and args[0] == Symbol("$") else args
        names = [n for b in inner.ins for n in binding_names(b)]
        outer: list[str] = []
        seed_columns: list[Column] = []
        for value, (shape, bound) in zip(args, inner.ins, strict=False):
            if shape == "scalar":
                seed_columns.append(c(self._arg(value, df)).alias(bound))
                if is_var(value):
                    outer.append((value.name, bound))
            elif shape == "collection" and is_var(value):
                outer.append((value.name, bound))
                seed_columns.append(F.explode(F.array_distinct(F.col(f"`{value.name}`"))).alias(bound))
            else:
                raise ValueError("a sub-query takes scalar and collection arguments")
        keys = [b for _, b in outer]
        seed = df.select(*seed_columns).distinct() if seed_columns else None
        compiler = Compiler(self.spark, self.catalog, inner.rules, self.functions, self.aggregates, self.allowed, self.constraints, self.nullsafe, self.most_rounds if inner.most_rounds is None else inner.most_rounds)
        if x.binding is None:
            rel = compiler.solve(inner.where, seed)
            if not keys:
                return df.join(rel.limit(1).select(F.lit(1).alias(fresh("__unit"))), F.lit(True), "left_semi")
            renamed = rel.select([F.col(f"`{b}`").alias(o) for o, b in outer]).distinct()
            return self.join(df, renamed, "left_semi")
        rel = compiler.solve(inner.where, seed)
        rows, columns = compiler.finish(inner, rel, [n for n in names if n in rel.columns])
        out_names = [fresh("__q") for _ in columns]
        rows = rows.select([F.col(f"`{b}`").alias(o) for o, b in outer] + [F.col(f"`{col}`").alias(n) for col, n in zip(columns, out_names, strict=True)])
        shape, bound = x.binding
        if shape == "relation":
            for name, col in zip(bound, out_names, strict=False):
                rows = rows.withColumnRenamed(col, name)
            return self.join(df, rows.select([o for o, _ in outer] + list(bound)).distinct())
        if shape == "collection":
            rows = rows.select(*[o for o, _ in outer], F.array(*[F.col(n) for n in out_names]).alias(bound))
            return self.join(df, rows)
        if shape == "tuple":
            if len(out_names) < len(bound):
                raise ValueError("a tuple binding of a sub-query takes its first row")
            first = rows.select(*[o for o, _ in outer], *[F.col(n).alias(b) for n, b in zip(out_names, bound, strict=False)])
            return self.join(df, first)
        packed = rows.groupBy(*[o for o, _ in outer]).agg(F.sort_array(F.collect_set(F.struct(*out_names))).alias(bound)) if outer else rows.agg(F.sort_array(F.collect_set(F.struct(*out_names))).alias(bound))
        return self.join(df, packed)

    # Negation, alternatives, rules.

    def _not(self, x: Not, df: DataFrame, rules: dict[str, DataFrame] | None) -> DataFrame:
        shared = sorted(variables(x))
        if missing := set(shared) - set(df.columns):
            raise Unbound(missing)
        if all(isinstance(y, Pred) and y.binding is None and y.fn not in (Symbol("q"), Symbol("get-attr")) and y.fn.name not in self.constraints for y in x.clauses):
            cond = F.lit(True)
            for y in x.clauses:
                cond = cond & self._condition(y, df)
            return df.where(~cond)
        body = self._body(x.clauses, df, shared, rules)
        kept = [n for n in shared if n in body.columns]
        if not kept:
            return df.join(body.limit(1).select(F.lit(1).alias(fresh("__unit"))), F.lit(True), "left_anti")
        return self.join(df, body.select(*[f"`{n}`" for n in kept]).distinct(), "left_anti")

    def _condition(self, y: Pred, df: DataFrame) -> Column:
        name = y.fn.name if is_var(y.fn) else ""
        if name in ("==", "!="):
            return self._unify(name, y.args, df)
        if name in RANGE_OPS and len(y.args) == 2:
            return F.coalesce(self._range(name, y.args, df), F.lit(False))
        return self._test(c(self.call(y.fn, y.args, df)), df)

    @staticmethod
    def _test(value: Column, df: DataFrame) -> Column:
        """Whether a value is neither nil nor false."""
        kind = df.select(value.alias("v")).schema[0].dataType
        return truthy(value) if isinstance(kind, T.BooleanType) else value.isNotNull()

    def _body(self, clauses: list, df: DataFrame | None, shared: list[str], rules: dict[str, DataFrame] | None) -> DataFrame:
        """A body on its own if it binds what it needs, else seeded with the outer values of all variables that it shares, so that what it needs comes joined to what it has."""
        try:
            return self.solve(clauses, None, rules)
        except Unbound as e:
            seed = sorted({n for n in e.names | set(shared) if df is not None and n in df.columns})
            if not seed:
                raise
            return self.solve(clauses, df.select(*[f"`{n}`" for n in seed]).distinct(), rules)

    def _or(self, x: Or, df: DataFrame | None, rules: dict[str, DataFrame] | None) -> DataFrame:
        names = sorted(variables(x))
        if df is not None and all(isinstance(y, Pred) and y.binding is None and y.fn not in (Symbol("q"), Symbol("get-attr")) and y.fn.name not in self.constraints for b in x.branches for y in b):
            cond = F.lit(False)
            for b in x.branches:
                one = F.lit(True)
                for y in b:
                    one = one & self._condition(y, df)
                cond = cond | one
            return df.where(cond)
        out = None
        for b in x.branches:
            body = self._body(b, df, names, rules)
            if lacking := [n for n in names if n not in body.columns]:
                seed = [n for n in lacking if df is not None and n in df.columns]
                body = body.crossJoin(df.select(*[f"`{n}`" for n in seed]).distinct())
            body = body.select(*[f"`{n}`" for n in names]) if names else body.select(F.lit(1).alias("__held"))
            if out is None:
                out = body
            else:
                out, body = self._aligned(out, body, out.columns)
                out = out.unionByName(body)
        out = out.distinct()
        if df is None:
            return out
        return self.join(df, out, "left_semi" if set(names) <= set(df.columns) else "inner")

    def _rule(self, x: RuleCall, df: DataFrame | None, rules: dict[str, DataFrame] | None) -> DataFrame:
        from tidemark.plans.rules import relation

        heads = self.heads(x)
        if len(x.args) != len(heads[0].args):
            raise ValueError(f"rule {x.name} takes {len(heads[0].args)} arguments")
        table = rules[x.name] if rules is not None and x.name in rules else relation(self, x, df, rules)
        keep, filters = {}, []
        for name, arg in zip(heads[0].args, x.args, strict=True):
            column = F.col(f"`{name}`")
            if is_var(arg):
                if arg.name in keep:
                    filters.append(keep[arg.name].eqNullSafe(column))
                keep.setdefault(arg.name, column)
            else:
                filters.append(self._equals(column, arg, table.schema[name].dataType))
        for f in filters:
            table = table.where(f)
        table = table.select([col.alias(n) for n, col in keep.items()]) if keep else table.limit(1).select(F.lit(1).alias(fresh("__held")))
        return table.distinct() if df is None else self.join(df, table.distinct())

    # Find.

    def finish(self, query: Query, rel: DataFrame, group: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """Project, aggregate, sort and page; `group` are columns of the seed that stay and partition limits."""
        group = group or []
        names, columns, aggregates, plain, some = [], [], [], [], []
        for k, term in enumerate(query.find):
            name = query.keys[k] if query.keys else self._title(term, k)
            while name in names or name in group:
                name = f"{name}_{k}"
            names.append(name)
            if is_var(term):
                if term.name not in rel.columns:
                    raise ValueError(f"find refers to unknown variable: {term.name}")
                plain.append(F.col(f"`{term.name}`").alias(name))
            elif isinstance(term, (Call, tuple)) and term[0] == Symbol("pull"):
                if term[1].name not in rel.columns:
                    raise ValueError(f"find refers to unknown variable: {term[1].name}")
                plain.append(F.col(f"`{term[1].name}`").alias(name))
            elif isinstance(term, (Call, tuple)):
                var = term[-1]
                if not is_var(var) or var.name not in rel.columns:
                    raise ValueError(f"find refers to unknown variable: {var}")
                if keeps_some(term[0].name, list(term[1:-1]), self.aggregates):
                    some.append((name, term[0].name, term[1], F.col(f"`{var.name}`")))
                else:
                    aggregates.append(aggregate(term[0].name, list(term[1:-1]), F.col(f"`{var.name}`"), self.aggregates).alias(name))
                plain.append(None)
            else:
                raise ValueError(f"not an element of find: {term!r}")
        columns = names
        if aggregates or some:
            keys = [F.col(f"`{g}`") for g in group] + [p for p in plain if p is not None]
            out = rel.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("__rows"))
            if some:
                by = group + [n for n, p in zip(names, plain, strict=True) if p is not None]
                whole = [n for n, p in zip(names, plain, strict=True) if p is None and n not in [s[0] for s in some]]
                for name, kind, n, x in some:
                    out = out.unionByName(some_values(rel.select(*keys, x.alias(name)), by, name, kind, n), allowMissingColumns=True)
                arrays = [F.coalesce(F.first(f"`{s[0]}`", ignorenulls=True), F.slice(F.array(F.lit(None)), 1, 0)).alias(s[0]) for s in some]
                out = out.groupBy(*[F.col(f"`{k}`") for k in by]).agg(*[F.first(f"`{n}`", ignorenulls=True).alias(n) for n in [*whole, "__rows"]], *arrays)
            out = out.where("__rows > 0")
            out = out.select(*[f"`{g}`" for g in group], *[f"`{n}`" for n in names])
        else:
            out = rel.select(*[F.col(f"`{g}`") for g in group], *plain)
            if not query.bag:
                out = self._distinct(query, out, names) if not group else out.distinct()
        order = [F.col(f"`{names[k]}`").asc_nulls_first() if way == "asc" else F.col(f"`{names[k]}`").desc_nulls_last() for k, way in query.order_by]
        if group and (query.limit is not None or query.offset is not None):
            number = F.row_number().over(W.partitionBy(*[f"`{g}`" for g in group]).orderBy(*(order or [F.lit(1)])))
            low, high = query.offset or 0, None if query.limit is None else (query.offset or 0) + query.limit
            out = out.withColumn("__n", number).where((F.col("__n") > low) & (F.lit(True) if high is None else F.col("__n") <= high)).drop("__n")
            return out, columns
        if order:
            out = out.orderBy(*order)
        if query.offset:
            out = out.offset(query.offset)
        if query.limit is not None:
            out = out.limit(query.limit)
        return out, columns

    def _distinct(self, query: Query, out: DataFrame, names: list[str]) -> DataFrame:
        """The distinct rows. If all values are computed from one row of a table whose id is among them, only rows with an id that is there again can be equal: the others pass a join with these ids only, and no task collects what is computed."""
        found = self._one_row(query)
        if found is None:
            return out.distinct()
        table, k = found
        key = fresh("__id")
        again = table.df.groupBy(F.col(f"`{table.eid}`").alias(key)).agg(F.count(F.lit(1)).alias("__rows")).where((F.col("__rows") > 1) | F.col(key).isNull()).select(key)
        same = F.col(f"`{names[k]}`").eqNullSafe(F.col(key))
        return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").distinct())

    def _one_row(self, query: Query) -> tuple[EntityTable, int] | None:
        """The table of whose single rows all else is computed, and where its id is in find; None if a clause may join or make rows, or if nothing is computed."""
        triples = [x for x in query.where if isinstance(x, Triple)]
        calls = [x for x in query.where if isinstance(x, Pred)]
        if query.ins or query.args or not triples or len(triples) + len(calls) != len(query.where) or not is_var(triples[0].e) or any(x.e != triples[0].e for x in triples):
            return None
        tables = self.catalog.holding({x.a for x in triples})
        if len(tables) != 1 or tables[0].eid is None or triples[0].e not in [t for t in query.find if is_var(t)] or any(isinstance(tables[0].kind(x.a), T.ArrayType) for x in triples):
            return None
        special = {"q", "get-attr", *self.constraints}
        if not any(x.binding for x in calls) or any((x.binding is not None and x.binding[0] not in ("scalar", "tuple")) or (is_var(x.fn) and x.fn.name in special) for x in calls):
            return None
        return tables[0], query.find.index(triples[0].e)

    @staticmethod
    def _title(term: object, k: int) -> str:
        if is_var(term):
            return term.name
        return re.sub(r"\W+", "_", f"{term[0].name}_{term[-1] if is_var(term[-1]) else term[1]}").strip("_")


def bind_inputs(spark: SparkSession, query: Query, args: list) -> DataFrame | None:
    """The relation of the query's arguments: one row, or the product of collections and relations."""
    out = None

    def frame(rows: list[tuple], names: list[str]) -> DataFrame:
        rows = [tuple(literal(v) for v in r) for r in rows]
        if not rows:
            return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
        if any(callable(v) for r in rows for v in r):
            raise ValueError("functions are passed by name")
        return spark.createDataFrame(rows, T.StructType([T.StructField(n, _type([r[k] for r in rows])) for k, n in enumerate(names)]))

    parts = []
    if len(args) < len(query.ins):
        raise ValueError(f"the query takes {len(query.ins)} arguments, got {len(args)}")
    for value, (shape, names) in zip(args, query.ins, strict=False):
        if isinstance(value, DataFrame):
            parts.append(value.toDF(*([names] if isinstance(names, str) else names)))
        elif shape == "scalar":
            parts.append(frame([(value,)], [names]))
        elif shape == "collection":
            parts.append(frame([(v,) for v in dict.fromkeys(value)], [names]))
        elif shape == "tuple":
            parts.append(frame([tuple(value)], names))
        else:
            parts.append(frame([tuple(r) for r in value], names))
    if query.args:
        keys = list(dict.fromkeys(k for row in query.args for k in row))
        parts.append(frame([tuple(row.get(k) for k in keys) for row in query.args], [k.name if isinstance(k, (Symbol, Keyword)) else str(k) for k in keys]))
    for p in parts:
        out = p if out is None else out.crossJoin(p)
    return out


def _type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} and kinds:
        return T.BooleanType()
    if kinds <= {int} and kinds:
        return T.LongType()
    if kinds <= {int, float} and kinds:
        return T.DoubleType()
    if kinds and all(issubclass(k, dt.datetime) for k in kinds):
        return T.TimestampType()
    if kinds and all(issubclass(k, dt.date) for k in kinds):
        return T.DateType()
    if kinds <= {Decimal, int} and kinds:
        return T.DecimalType(38, 18)
    if kinds and all(issubclass(k, (list, tuple, set, frozenset)) for k in kinds):
        return T.ArrayType(_type([v for vs in values if vs is not None for v in vs]))
    return T.StringType()
