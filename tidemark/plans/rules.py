"""Rules: relations over their head's arguments, by expansion or by a semi-naive fixpoint.

A group of rules that call each other is filled together: each round joins what the last round
added with all that is known, and keeps what is new. Rounds are cut by tables in the shared
folder. A rule whose arguments are computed, not found, is first told which arguments are asked
for; these demands are a fixpoint of their own.

Rules over stored values run until no row is new, however many rounds that takes. Rules that
compute new values may never end: their rounds are bounded, by the query's :most-rounds.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.edn import Symbol
from tidemark.plans.parse import Not, Or, Pred, Rule, RuleCall, Triple, is_var, variables
from tidemark.workspace import cut

if TYPE_CHECKING:
    from collections.abc import Iterable

    from tidemark.plans.compile import Compiler

#: Rounds after which a fixpoint that computes new values is given up as endless, where the query does not say.
MOST_ROUNDS = 200

#: Functions whose results are values that exist already.
STORED = (Symbol("identity"), Symbol("get-attr"))

#: Tables of as many rounds, and then of as many such tables, become one: plans stay short over any number of rounds.
MERGED = 8


def calls(clauses: list, negated: bool = False) -> list[tuple[str, bool]]:
    out = []
    for x in clauses:
        if isinstance(x, RuleCall):
            out.append((x.name, negated))
        elif isinstance(x, Not):
            out += calls(x.clauses, True)
        elif isinstance(x, Or):
            out += [y for b in x.branches for y in calls(b, negated)]
    return out


def group_of(rules: dict[str, list[Rule]], name: str) -> set[str]:
    """The rules that reach `name` and are reached by it; empty if it is not recursive."""

    def reach(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for called, _ in (y for r in rules.get(todo.pop(), []) for y in calls(r.clauses)):
                if called not in seen:
                    seen.add(called)
                    todo.append(called)
        return seen

    return {n for n in reach(name) if name in reach(n)}


def computes(compiler: Compiler, group: set[str]) -> bool:
    """Whether a rule of the group, or one that it calls, binds values that are not stored."""

    def binds(clauses: list) -> bool:
        for x in clauses:
            if isinstance(x, Pred) and x.binding is not None and (x.fn not in STORED or x.fn.name in compiler.functions):
                return True
            if binds(x.clauses if isinstance(x, Not) else [y for b in x.branches for y in b] if isinstance(x, Or) else []):
                return True
        return False

    seen, todo = set(group), list(group)
    while todo:
        for r in compiler.rules.get(todo.pop(), []):
            if binds(r.clauses):
                return True
            new = {n for n, _ in calls(r.clauses)} - seen
            seen |= new
            todo += new
    return False


def _rounds(compiler: Compiler, group: set[str]) -> Iterable[int]:
    if not computes(compiler, group):
        return count()
    return range(MOST_ROUNDS if compiler.most_rounds is None else compiler.most_rounds)


class Grown:
    """A relation that grows by a table a round."""

    def __init__(self, first: DataFrame) -> None:
        self.parts = [(0, first)]

    def add(self, df: DataFrame) -> DataFrame:
        self.parts.append((0, df))
        while len(self.parts) >= MERGED and self.parts[-MERGED][0] == self.parts[-1][0]:
            level = self.parts[-1][0]
            self.parts[-MERGED:] = [(level + 1, cut(reduce(DataFrame.union, [d for _, d in self.parts[-MERGED:]]), "rule"))]
        return reduce(DataFrame.union, [d for _, d in self.parts])


def relation(compiler: Compiler, call: RuleCall, df: DataFrame | None, rules: dict[str, DataFrame] | None) -> DataFrame:
    from tidemark.plans.compile import Unbound

    name = call.name
    key = f"{name}/{compiler.nullsafe}"
    if key in compiler.relations:
        return compiler.relations[key]
    group = group_of(compiler.rules, name)
    for member in group:
        for r in compiler.rules[member]:
            if any(n in group and negated for n, negated in calls(r.clauses)):
                raise ValueError(f"rule {member} depends on its own negation")
    try:
        out = _fixpoint(compiler, group, rules)[name] if group else _union([_head(compiler, r, None, rules) for r in compiler.rules[name]], compiler)
        compiler.relations[key] = out
        return out
    except Unbound:
        seeds = _asked(compiler, call, df)
        if not group:
            return _union([_head(compiler, r, seeds, rules) for r in compiler.rules[name]], compiler)
        if group != {name}:
            raise
        return _demanded(compiler, name, seeds)


def _head(compiler: Compiler, rule: Rule, seed: DataFrame | None, rules: dict[str, DataFrame] | None) -> DataFrame:
    body = compiler.solve(rule.clauses, seed, rules)
    return body.select(*[f"`{n}`" for n in rule.args])


def _union(parts: list[DataFrame], compiler: Compiler) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out, p = compiler._aligned(out, p.toDF(*out.columns), out.columns)
        out = out.union(p)
    return out.distinct()


def _fixpoint(compiler: Compiler, group: set[str], rules: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    base = {n: [r for r in compiler.rules[n] if not any(c in group for c, _ in calls(r.clauses))] for n in group}
    if not any(base.values()):
        raise ValueError(f"rules {sorted(group)} have no case that ends")
    known: dict[str, DataFrame] = {}
    waiting = set(group)
    for n in sorted(group):
        if base[n]:
            known[n] = cut(_union([_head(compiler, r, None, rules) for r in base[n]], compiler), "rule")
            waiting.discard(n)
    example = next(iter(known.values()))
    for n in waiting:
        names = compiler.rules[n][0].args
        known[n] = compiler.spark.createDataFrame([], ", ".join(f"`{a}` {example.dtypes[min(k, len(example.columns) - 1)][1]}" for k, a in enumerate(names)))
    delta, grown = dict(known), {n: Grown(d) for n, d in known.items()}
    for _ in _rounds(compiler, group):
        added: dict[str, DataFrame] = {}
        for n in sorted(group):
            made = []
            for r in compiler.rules[n]:
                at = [k for k, x in enumerate(r.clauses) if isinstance(x, RuleCall) and x.name in group]
                inner = len([c for c, _ in calls(r.clauses) if c in group]) > len(at)
                if inner:
                    made.append(_head(compiler, r, None, {**(rules or {}), **known}))
                for k in at:
                    clauses = list(r.clauses)
                    clauses[k] = replace(clauses[k], name="Δ" + clauses[k].name)
                    full = {**(rules or {}), **known, **{"Δ" + m: d for m, d in delta.items()}}
                    made.append(_head(compiler, replace(r, clauses=clauses), None, full))
            if made:
                fresh_rows = _union(made, compiler).toDF(*known[n].columns)
                a, b = compiler._aligned(fresh_rows, known[n], known[n].columns)
                added[n] = cut(a.join(b, known[n].columns, "left_anti"), "rule")
        added = {n: d for n, d in added.items() if not d.isEmpty()}
        if not added:
            return known
        for n, d in added.items():
            known[n] = grown[n].add(d)
        delta = {n: added.get(n, known[n].limit(0)) for n in group}
    raise ValueError(f"rules {sorted(group)} did not end within the rounds allowed; :most-rounds allows more")


def _asked(compiler: Compiler, call: RuleCall, df: DataFrame | None) -> DataFrame:
    """Distinct values of the arguments that the call binds, by the head's names."""
    from tidemark.functions.scalar import c
    from tidemark.plans.compile import Unbound, literal

    head = compiler.heads(call)[0]
    columns = []
    for name, arg in zip(head.args, call.args, strict=True):
        if not is_var(arg):
            columns.append(c(literal(arg)).alias(name))
        elif df is not None and arg.name in df.columns:
            columns.append(F.col(f"`{arg.name}`").alias(name))
    if not columns:
        raise Unbound(variables(call))
    return (df if df is not None else compiler.spark.range(1)).select(*columns).distinct()


def _demanded(compiler: Compiler, name: str, asked: DataFrame) -> DataFrame:
    heads, given = compiler.rules[name], asked.columns
    places = [heads[0].args.index(n) for n in given]
    demand = cut(asked, "demand")
    new, grown = demand, Grown(demand)
    for _ in _rounds(compiler, {name}):
        more = []
        for r in heads:
            inner = [x for x in r.clauses if isinstance(x, RuleCall) and x.name == name]
            if not inner:
                continue
            seed = new.toDF(*[r.args[p] for p in places])
            bound, rest, before = set(seed.columns), [x for x in r.clauses if not (isinstance(x, RuleCall) and x.name == name)], []
            progress = True
            while progress:
                progress = False
                for x in list(rest):
                    if isinstance(x, Triple) or (isinstance(x, Pred) and compiler._needs(x) <= bound):
                        before.append(x)
                        rest.remove(x)
                        bound |= variables(x)
                        progress = True
            body = compiler.solve(before, seed)
            for x in inner:
                args = [x.args[p] for p in places]
                more.append(body.select(*[(F.col(f"`{a.name}`") if is_var(a) else F.lit(a)).alias(n) for a, n in zip(args, given, strict=True)]))
        if not more:
            break
        step, held = compiler._aligned(_union(more, compiler), demand, given)
        new = cut(step.join(held, given, "left_anti"), "demand")
        if new.isEmpty():
            break
        demand = grown.add(new)
    else:
        raise ValueError(f"the arguments asked of rule {name} did not end within the rounds allowed; :most-rounds allows more")
    base = [r for r in heads if not any(c == name for c, _ in calls(r.clauses))]
    seeds = lambda r: demand.toDF(*[r.args[p] for p in places])
    known = cut(_union([_head(compiler, r, seeds(r), None) for r in base], compiler), "rule")
    grown = Grown(known)
    for _ in _rounds(compiler, {name}):
        made = [_head(compiler, r, seeds(r), {name: known}) for r in heads if r not in base]
        step, held = compiler._aligned(_union(made, compiler).toDF(*known.columns), known, known.columns)
        new = cut(step.join(held, known.columns, "left_anti"), "rule")
        if new.isEmpty():
            return known
        known = grown.add(new)
    raise ValueError(f"rule {name} did not end within the rounds allowed; :most-rounds allows more")
