"""Pull: nested projections. As joins and struct columns where the depth is known; level by level where it recurs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.edn import Call, Keyword, Symbol, freeze, read
from tidemark.functions.scalar import c
from tidemark.model import Catalog
from tidemark.plans.parse import attribute


@dataclass
class Prop:
    attribute: str
    name: str
    reverse: bool = False
    one: bool = False
    default: object = None
    limit: int | None = None
    into: str | None = None
    sub: list | None = None
    depth: int | None = None
    union: dict = field(default_factory=dict)


def parse_spec(spec: object) -> list:
    """A list of Prop and "*"."""
    if isinstance(spec, str):
        spec = read(spec)
    out: list = []
    for item in spec:
        if item == Symbol("*") or item == "*":
            out.append("*")
        elif isinstance(item, dict):
            for key, sub in item.items():
                p = _prop(key)
                if sub == Symbol("...") or sub == "...":
                    p.sub, p.depth = spec, -1
                elif isinstance(sub, int) and not isinstance(sub, bool):
                    p.sub, p.depth = spec, sub
                elif isinstance(sub, dict):
                    p.union = {(k if not isinstance(k, Keyword) else repr(k)): v for k, v in sub.items()}
                else:
                    p.sub = list(sub)
                out.append(p)
        else:
            out.append(_prop(item))
    return out


def _prop(key: object) -> Prop:
    options: dict = {}
    if isinstance(key, (Call, tuple)) and len(key) == 2:
        key, raw = key
        raw = dict(raw) if not isinstance(raw, dict) else raw
        options = {k.name if isinstance(k, Keyword) else k: v for k, v in raw.items()}
    text = key.name if isinstance(key, Keyword) else str(key)
    space, _, local = text.rpartition("/")
    reverse = local.startswith("_") and local != "_id"
    plain = f"{space}/{local[1:]}" if space and reverse else local[1:] if reverse else text
    name = options.get("as", text)
    into = options.get("into")
    return Prop(attribute(Keyword(plain)), name.name if isinstance(name, Keyword) else str(name), reverse, getattr(options.get("cardinality"), "name", options.get("cardinality")) == "one", options.get("default"), options.get("limit"), None if into is None else "set" if isinstance(into, frozenset) else "list")


def pull_columns(catalog: Catalog, ids: DataFrame, spec: object, key: str = "eid", out: str = "pulled") -> DataFrame:
    """ids with a struct column `out`: the entity pulled by a specification of known depth. Entities that don't exist have null fields.

    Forward joins look their targets up by id, to-many values by a collected list of structs;
    reverse joins group the referring entities. Every level is one join.
    """
    rows, columns = ids, []
    for p in parse_spec(spec):
        if p == "*":
            table = next(t for t in catalog.tables.values() if t.eid is not None)
            every = F.struct(*[F.col(col).alias(a) for a, col in table.attributes.items()])
            found = table.df.select(F.col(table.eid).alias("__all_k"), every.alias("__all"))
            rows = rows.join(found, F.col(f"`{key}`") == F.col("__all_k"), "left").drop("__all_k")
            columns += [F.col("__all").getField(a).alias(a) for a in table.attributes]
            continue
        if p.depth is not None and p.depth < 0:
            raise ValueError("an unbounded recursion is pulled by assemble()")
        place = f"__{len(columns)}_{p.name}"
        found = _field(catalog, p, place)
        found = found.select(F.col("__k").alias(f"{place}_k"), f"`{place}`")
        rows = rows.join(found, F.col(f"`{key}`") == F.col(f"`{place}_k`"), "left").drop(f"{place}_k")
        value: Column = F.col(f"`{place}`")
        if p.default is not None:
            value = F.coalesce(value, c(p.default))
        columns.append(value.alias(p.name))
    return rows.select(*ids.columns, (F.struct(*columns) if columns else F.struct()).alias(out))


def _field(catalog: Catalog, p: Prop, place: str) -> DataFrame:
    tables = [t for t in catalog.holding({p.attribute}) if t.eid is not None]
    if not tables:
        raise ValueError(f"no table with ids has the attribute {p.attribute}")
    table = tables[0]
    column = table.column(p.attribute)
    many = isinstance(table.df.schema[column].dataType, T.ArrayType)
    base = table.df.select(F.col(table.eid).alias("__k"), F.col(column).alias("__v"))
    if p.reverse:
        facts = base.select(F.col("__k").alias("eid"), (F.explode(F.array_distinct("__v")) if many else F.col("__v")).alias("__k")).where("__k IS NOT NULL")
        if p.sub is not None:
            facts = pull_columns(catalog, facts, p.sub).select("__k", F.col("pulled").alias("eid"))
        grouped = facts.groupBy("__k").agg((F.first("eid") if p.one else F.sort_array(F.collect_list("eid"))).alias(place))
        return grouped if p.limit is None or p.one else grouped.withColumn(place, F.slice(place, 1, p.limit))
    if p.sub is not None and p.depth is None:
        facts = base.select("__k", (F.explode(F.array_distinct("__v")) if many else F.col("__v")).alias("eid")).where("eid IS NOT NULL")
        facts = pull_columns(catalog, facts, p.sub).select("__k", F.col("pulled").alias("__v"))
        if not many:
            return facts.select("__k", F.col("__v").alias(place))
        base = facts.groupBy("__k").agg(F.sort_array(F.collect_list("__v")).alias("__v"))
    elif p.depth is not None:
        if p.depth == 0:
            return base.select("__k", F.lit(None).cast("string").alias(place)).limit(0)
        inner = [q if not (isinstance(q, dict) and p.depth is not None) else {k: v - 1 if isinstance(v, int) else v for k, v in q.items()} for q in p.sub]
        return _field(catalog, Prop(p.attribute, p.name, p.reverse, p.one, p.default, p.limit, p.into, inner), place)
    value = F.col("__v")
    if many:
        value = F.array_distinct(value)
        value = value if p.limit is None else F.slice(value, 1, p.limit)
    return base.select("__k", value.alias(place))


def assemble(fetch: Callable[[list], dict], referring: Callable[[str, list], dict], ids: Iterable, spec: object) -> list[dict]:
    """Each id's entity as nested dicts. fetch gives the documents of ids, referring those whose attribute holds an id.

    Each level of a specification asks for all its documents at once; recursion ends at entities
    on the path already. Unknown ids and empty specifications give empty maps.
    """
    known: dict = {}

    def load(wanted: list) -> None:
        if missing := [i for i in dict.fromkeys(wanted) if i not in known]:
            got = fetch(missing)
            known.update({i: got.get(i) for i in missing})

    def values(doc: dict, name: str) -> tuple[list, bool]:
        v = doc.get(name)
        many = isinstance(v, (list, tuple, set, frozenset))
        return (list(v) if many else [] if v is None else [v]), many

    def run(entities: list, spec: object, seen: dict, depth: int | None = None) -> list[dict]:
        props = parse_spec(spec)
        load(entities)
        out: list[dict] = [{} for _ in entities]
        for p in props:
            if p == "*":
                for row, e in zip(out, entities, strict=True):
                    row.update(known[e] or {})
                continue
            if p.reverse:
                back = referring(p.attribute, list(dict.fromkeys(entities)))
                for row, e in zip(out, entities, strict=True):
                    found = back.get(e, [])[: p.limit]
                    if found:
                        got = run(found, p.sub, seen) if p.sub is not None else found
                        row[p.name] = got[0] if p.one else got
                    elif p.default is not None:
                        row[p.name] = p.default
                continue
            targets: list = []
            for e in entities:
                targets += values(known[e] or {}, p.attribute)[0][: p.limit]
            if p.sub is not None or p.union:
                load(targets)
            for row, e in zip(out, entities, strict=True):
                doc = known[e] or {}
                if p.attribute not in doc:
                    if p.default is not None:
                        row[p.name] = p.default
                    continue
                found, many = values(doc, p.attribute)
                found = found[: p.limit]
                if p.union:
                    value = [run([v], p.union[kind], seen)[0] if (kind := doc.get(p.attribute)) in p.union else {} for v in found]
                    row.update(run([e], p.union[doc[p.attribute]], seen)[0]) if doc[p.attribute] in p.union else None
                    continue
                if p.sub is not None:
                    left = p.depth if depth is None or p.depth is None else depth
                    if p.depth is not None:
                        path = seen.get(e, frozenset()) | {e}
                        found = [v for v in found if v not in path]
                        if left == 0 or not found:
                            continue
                        deeper = {**seen, **{v: path for v in found}}
                        value = run(found, p.sub, deeper, None if left < 0 else left - 1) if left else []
                    else:
                        value = run(found, p.sub, seen)
                else:
                    value = found
                if p.into == "set" and p.sub is None:
                    row[p.name] = frozenset(freeze(value))
                else:
                    row[p.name] = value if many else value[0] if value else None
        return out

    return run(list(ids), spec, {})
