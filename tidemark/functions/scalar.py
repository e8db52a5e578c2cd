"""Scalar functions: query names to Column expressions, so that calls stay inside code generation.

Arguments arrive as Columns or as plain Python values (literals of the query). Booleans are
two-valued where the query language is: a test of nothing is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.edn import Keyword

Arg = object


def is_column(x: Arg) -> bool:
    return isinstance(x, Column)


def c(x: Arg) -> Column:
    """A Column of any argument; keywords are strings with their colon, collections arrays, maps maps."""
    if isinstance(x, Column):
        return x
    if isinstance(x, Keyword):
        return F.lit(repr(x))
    if isinstance(x, (list, tuple, set, frozenset)):
        return F.array(*[c(v) for v in x]) if x else F.array().cast("array<string>")
    if isinstance(x, dict):
        return F.create_map(*[c(v) for pair in x.items() for v in pair])
    if isinstance(x, Decimal):
        return F.lit(x)
    return F.lit(x)


def truthy(x: Column) -> Column:
    """nil and false are false, all else is true."""
    return F.coalesce(x, F.lit(False))


def _fold(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(first: Arg, *rest: Arg) -> Column:
        out = c(first)
        for x in rest:
            out = op(out, c(x))
        return out

    return run


def _chain(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(*xs: Arg) -> Column:
        out = F.lit(True)
        for a, b in zip(xs, xs[1:], strict=False):
            out = out & F.coalesce(op(c(a), c(b)), F.lit(False))
        return out

    return run


def _big(x: Arg) -> Column:
    return c(x).cast("decimal(38,0)")


def _minus(first: Arg, *rest: Arg) -> Column:
    return _fold(lambda a, b: a - b)(first, *rest) if rest else -c(first)


def _divide(first: Arg, *rest: Arg) -> Column:
    return _fold(lambda a, b: a.cast("double") / b.cast("double"))(first, *rest) if rest else F.lit(1.0) / c(first).cast("double")


def _quot(a: Arg, b: Arg) -> Column:
    q = c(a) / c(b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def _mod(a: Arg, b: Arg) -> Column:
    return c(a) - F.floor(c(a) / c(b)) * c(b)


def _equal(*xs: Arg) -> Column:
    out = F.lit(True)
    for a, b in zip(xs, xs[1:], strict=False):
        out = out & c(a).eqNullSafe(c(b))
    return out


def _compare(a: Arg, b: Arg) -> Column:
    a, b = c(a), c(b)
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def _regex(pattern: Arg) -> str:
    if is_column(pattern):
        raise ValueError("a pattern must be a literal")
    return pattern.pattern if isinstance(pattern, re.Pattern) else str(pattern)


def _find(pattern: Arg, text: Arg) -> Column:
    found = F.regexp_extract(c(text), _regex(pattern), 0)
    return F.when(c(text).rlike(_regex(pattern)), found)


def _subs(text: Arg, start: Arg, end: Arg = None) -> Column:
    text, start = c(text), c(start).cast("int")
    size = F.length(text) - start if end is None else c(end).cast("int") - start
    return F.substring(text, start + 1, size)


def _str(*xs: Arg) -> Column:
    return F.concat(*[F.coalesce(c(x).cast("string"), F.lit("")) for x in xs]) if xs else F.lit("")


def _format(pattern: Arg, *xs: Arg) -> Column:
    return F.format_string(str(pattern), *[c(x) for x in xs])


def _get(target: Arg, key: Arg, default: Arg = None) -> Column:
    if isinstance(target, dict):
        value = F.try_element_at(c(target), c(key))
    else:
        value = F.try_element_at(c(target), c(key) + 1 if isinstance(key, int) else c(key))
    return value if default is None else F.coalesce(value, c(default))


def _contains(target: Arg, key: Arg) -> Column:
    if isinstance(target, (set, frozenset)):
        return c(key).isin([v if not isinstance(v, Keyword) else repr(v) for v in target]) if target else F.lit(False)
    if isinstance(target, dict):
        return F.map_contains_key(c(target), c(key))
    return truthy(F.array_contains(c(target), c(key)))


def _slice_from(x: Arg, n: Arg) -> Column:
    x, n = c(x), c(n).cast("int")
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def _count(x: Arg) -> Column:
    if isinstance(x, str):
        return F.lit(len(x))
    return F.coalesce(F.size(c(x)), F.lit(0)) if not is_column(x) else F.when(c(x).isNull(), 0).otherwise(F.length(c(x).cast("string")))


def _frequencies(x: Arg) -> Column:
    x = c(x)
    return F.map_from_entries(F.transform(F.array_distinct(x), lambda v: F.struct(v, F.size(F.filter(x, lambda w: w == v)))))


def _type_test(*kinds: type) -> Callable[[Arg], Arg]:
    """Folded from the static type where the compiler knows it: a test gets (value, type)."""

    def run(x: Arg, kind: T.DataType | None = None) -> Column:
        if is_column(x):
            return (c(x).isNotNull()) if kind is not None and isinstance(kind, kinds) else F.lit(False)
        return F.lit(x is not None and isinstance(_type_of(x), kinds))

    run.typed = True
    return run


def _type_of(x: object) -> T.DataType:
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.LongType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, Decimal):
        return T.DecimalType(38, 18)
    if isinstance(x, dict):
        return T.MapType(T.StringType(), T.StringType())
    if isinstance(x, (list, tuple, set, frozenset)):
        return T.ArrayType(T.StringType())
    return T.StringType()


def _bit(n: Arg) -> Column:
    return F.expr("1L") if isinstance(n, int) and n == 0 else F.shiftleft(F.lit(1).cast("long"), int(n))


def _keyword_like(x: Arg) -> Column:
    return F.when(c(x).startswith(":"), c(x)).otherwise(F.concat(F.lit(":"), c(x).cast("string")))


def _seq(op: Callable[[Column], Column]) -> Callable[[Arg], Column]:
    return lambda x: op(c(x))


_NUMBER, _INT, _REAL = T.NumericType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType), (T.FloatType, T.DoubleType)

REGISTRY: dict[str, Callable[..., Column]] = {
    # Arithmetic.
    "+": _fold(lambda a, b: a + b), "*": _fold(lambda a, b: a * b), "-": _minus, "/": _divide,
    "+'": lambda *x: _fold(lambda a, b: a + b)(*map(_big, x)), "*'": lambda *x: _fold(lambda a, b: a * b)(*map(_big, x)), "-'": lambda *x: _minus(*map(_big, x)),
    "inc": lambda x: c(x) + 1, "dec": lambda x: c(x) - 1, "inc'": lambda x: _big(x) + 1, "dec'": lambda x: _big(x) - 1,
    "quot": _quot, "rem": lambda a, b: c(a) % c(b), "mod": _mod, "num": c, "rationalize": c, "abs": lambda x: F.abs(c(x)),
    "max": lambda *x: F.greatest(*map(c, x)) if len(x) > 1 else c(x[0]), "min": lambda *x: F.least(*map(c, x)) if len(x) > 1 else c(x[0]),
    "rand": lambda n=1: F.rand() * c(n), "rand-int": lambda n: F.floor(F.rand() * c(n)), "rand-nth": lambda x: F.element_at(F.shuffle(c(x)), 1),
    "shuffle": _seq(F.shuffle), "random-sample": lambda p, x: F.filter(c(x), lambda _: F.rand() < c(p)),
    # Comparison.
    "<": _chain(lambda a, b: a < b), "<=": _chain(lambda a, b: a <= b), ">": _chain(lambda a, b: a > b), ">=": _chain(lambda a, b: a >= b),
    "=": _equal, "==": _equal, "not=": lambda *x: ~_equal(*x), "!=": lambda *x: ~_equal(*x), "identical?": _equal, "compare": _compare,
    "distinct?": lambda *x: F.size(F.array_distinct(F.array(*map(c, x)))) == len(x),
    # Bits.
    "bit-and": _fold(lambda a, b: a.bitwiseAND(b)), "bit-or": _fold(lambda a, b: a.bitwiseOR(b)), "bit-xor": _fold(lambda a, b: a.bitwiseXOR(b)),
    "bit-not": lambda x: F.bitwise_not(c(x)), "bit-and-not": lambda a, b: c(a).bitwiseAND(F.bitwise_not(c(b))),
    "bit-shift-left": lambda x, n: F.shiftleft(c(x), int(n)), "bit-shift-right": lambda x, n: F.shiftright(c(x), int(n)), "unsigned-bit-shift-right": lambda x, n: F.shiftrightunsigned(c(x).cast("long"), int(n)),
    "bit-set": lambda x, n: c(x).cast("long").bitwiseOR(_bit(n)), "bit-clear": lambda x, n: c(x).cast("long").bitwiseAND(F.bitwise_not(_bit(n))),
    "bit-flip": lambda x, n: c(x).cast("long").bitwiseXOR(_bit(n)), "bit-test": lambda x, n: F.getbit(c(x).cast("long"), c(n).cast("int")) == 1,
    # Tests of numbers and values.
    "even?": lambda x: truthy(c(x) % 2 == 0), "odd?": lambda x: truthy(c(x) % 2 != 0), "pos?": lambda x: truthy(c(x) > 0), "neg?": lambda x: truthy(c(x) < 0), "zero?": lambda x: truthy(c(x) == 0),
    "pos-int?": lambda x: truthy(c(x) > 0), "neg-int?": lambda x: truthy(c(x) < 0), "nat-int?": lambda x: truthy(c(x) >= 0),
    "nil?": lambda x: c(x).isNull(), "some?": lambda x: c(x).isNotNull(), "any?": lambda x: F.lit(True), "true?": lambda x: c(x).eqNullSafe(F.lit(True)), "false?": lambda x: c(x).eqNullSafe(F.lit(False)),
    "number?": _type_test(_NUMBER), "int?": _type_test(*_INT), "integer?": _type_test(*_INT), "double?": _type_test(T.DoubleType), "float?": _type_test(*_REAL), "decimal?": _type_test(T.DecimalType),
    "rational?": _type_test(*_INT, T.DecimalType), "ratio?": lambda x: F.lit(False), "string?": _type_test(T.StringType), "char?": _type_test(T.StringType), "boolean?": _type_test(T.BooleanType),
    "inst?": _type_test(T.TimestampType, T.DateType), "bytes?": _type_test(T.BinaryType), "map?": _type_test(T.MapType, T.StructType), "associative?": _type_test(T.MapType, T.StructType, T.ArrayType),
    "coll?": _type_test(T.ArrayType, T.MapType), "counted?": _type_test(T.ArrayType, T.MapType), "sequential?": _type_test(T.ArrayType), "vector?": _type_test(T.ArrayType), "seq?": _type_test(T.ArrayType),
    "list?": _type_test(T.ArrayType), "set?": _type_test(T.ArrayType), "indexed?": _type_test(T.ArrayType), "reversible?": _type_test(T.ArrayType), "seqable?": _type_test(T.ArrayType, T.MapType, T.StringType),
    "record?": _type_test(T.StructType), "sorted?": lambda x: F.lit(False),
    "keyword?": lambda x: truthy(c(x).cast("string").startswith(":")), "ident?": lambda x: truthy(c(x).cast("string").startswith(":")), "simple-keyword?": lambda x: truthy(c(x).cast("string").rlike("^:[^/]+$")),
    "qualified-keyword?": lambda x: truthy(c(x).cast("string").rlike("^:[^/]+/.+$")), "qualified-ident?": lambda x: truthy(c(x).cast("string").rlike("^:[^/]+/.+$")), "simple-ident?": lambda x: truthy(c(x).cast("string").rlike("^:[^/]+$")),
    "symbol?": lambda x: F.lit(False), "simple-symbol?": lambda x: F.lit(False), "qualified-symbol?": lambda x: F.lit(False),
    "uuid?": lambda x: truthy(c(x).cast("string").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), "uri?": lambda x: truthy(c(x).cast("string").rlike("^[a-z][a-z0-9+.-]*://")), "type": lambda x: F.typeof(c(x)),
    "instance?": lambda kind, x: F.typeof(c(x)) == str(kind),
    # Casts.
    "long": lambda x: c(x).cast("long"), "int": lambda x: c(x).cast("int"), "short": lambda x: c(x).cast("short"), "byte": lambda x: c(x).cast("byte"), "double": lambda x: c(x).cast("double"), "float": lambda x: c(x).cast("float"),
    "bigdec": lambda x: c(x).cast("decimal(38,18)"), "bigint": _big, "biginteger": _big, "boolean": lambda x: truthy(c(x)) if not is_column(x) else F.coalesce(c(x).cast("string") != "false", F.lit(False)),
    "char": lambda x: F.chr(c(x)), "cast": lambda kind, x: c(x).cast(str(kind)), "keyword": _keyword_like, "symbol": lambda x: c(x).cast("string"),
    "name": lambda x: F.regexp_extract(c(x).cast("string"), r"([^/:]+|/)$", 1), "namespace": lambda x: F.nullif(F.regexp_extract(c(x).cast("string"), r"^:?([^/]+)/.", 1), F.lit("")),
    "ns-name": lambda x: c(x).cast("string"), "gensym": lambda: F.uuid(),
    # Arrays of one type.
    **{name: (lambda kind: lambda x: c(x).cast(f"array<{kind}>"))(kind) for name, kind in {"booleans": "boolean", "bytes": "tinyint", "chars": "string", "doubles": "double", "floats": "float", "ints": "int", "longs": "bigint", "shorts": "smallint"}.items()},
    "aget": lambda x, i: F.element_at(c(x), c(i).cast("int") + 1), "alength": _seq(F.size), "into-array": c, "to-array-2d": c, "vector-of": lambda kind, *x: F.array(*map(c, x)),
    # Logic.
    "not": lambda x: ~truthy(c(x)), "empty?": lambda x: F.coalesce(F.size(c(x)) == 0, F.lit(True)), "not-empty": lambda x: F.when(F.size(c(x)) > 0, c(x)), "empty": lambda x: F.slice(c(x), 1, 0),
    # Text.
    "str": _str, "pr-str": lambda *x: _str(*x), "subs": _subs, "format": _format, "re-find": _find, "re-seq": lambda p, x: F.regexp_extract_all(c(x), F.lit(_regex(p)), F.lit(0)),
    "re-matches": lambda p, x: F.when(c(x).rlike(f"^(?:{_regex(p)})$"), c(x)), "re-groups": lambda p, x: F.regexp_extract_all(c(x), F.lit(_regex(p)), F.lit(1)), "re-pattern": lambda p: p, "re-matcher": lambda p, x: _find(p, x),
    "starts-with?": lambda x, p: truthy(c(x).startswith(c(p))), "ends-with?": lambda x, p: truthy(c(x).endswith(c(p))), "includes?": lambda x, p: truthy(c(x).contains(c(p))),
    "upper-case": _seq(F.upper), "lower-case": _seq(F.lower), "capitalize": lambda x: F.concat(F.upper(F.substring(c(x), 1, 1)), F.lower(F.substring(c(x), 2, 1 << 30))), "trim": _seq(F.trim), "triml": _seq(F.ltrim), "trimr": _seq(F.rtrim),
    "blank?": lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True)), "split": lambda x, p: F.split(c(x), _regex(p)), "join": lambda sep, x: F.array_join(c(x), sep), "index-of": lambda x, p: F.nullif(F.instr(c(x), p) - 1, F.lit(-1)), "string-length": _seq(F.length), "string-reverse": _seq(F.reverse),
    # Sequences.
    "count": _count, "size": _seq(F.size), "first": lambda x: F.get(c(x), F.lit(0)), "second": lambda x: F.get(c(x), F.lit(1)), "last": lambda x: F.try_element_at(c(x), F.lit(-1)), "peek": lambda x: F.try_element_at(c(x), F.lit(-1)),
    "ffirst": lambda x: F.try_element_at(F.get(c(x), F.lit(0)), F.lit(1)), "fnext": lambda x: F.get(c(x), F.lit(1)), "nth": lambda x, n: F.element_at(c(x), c(n).cast("int") + 1),
    "rest": lambda x: _slice_from(x, 1), "next": lambda x: F.when(F.size(c(x)) > 1, _slice_from(x, 1)), "nfirst": lambda x: _slice_from(F.element_at(c(x), 1), 1), "nnext": lambda x: _slice_from(x, 2), "nthrest": lambda x, n: _slice_from(x, n), "nthnext": lambda x, n: F.when(F.size(c(x)) > c(n), _slice_from(x, n)),
    "butlast": lambda x: F.slice(c(x), F.lit(1), F.greatest(F.size(c(x)) - 1, F.lit(0))), "drop-last": lambda x: F.slice(c(x), F.lit(1), F.greatest(F.size(c(x)) - 1, F.lit(0))), "pop": lambda x: F.slice(c(x), F.lit(1), F.greatest(F.size(c(x)) - 1, F.lit(0))),
    "take": lambda n, x: F.slice(c(x), F.lit(1), c(n).cast("int")), "drop": lambda n, x: _slice_from(x, n), "take-last": lambda n, x: F.slice(c(x), F.greatest(F.size(c(x)) - c(n).cast("int") + 1, F.lit(1)), c(n).cast("int")),
    "take-nth": lambda n, x: F.filter(c(x), lambda _, i: i % c(n) == 0), "split-at": lambda n, x: F.array(F.slice(c(x), F.lit(1), c(n).cast("int")), _slice_from(x, n)), "subvec": lambda x, a, b: F.slice(c(x), c(a).cast("int") + 1, c(b).cast("int") - c(a).cast("int")),
    "conj": lambda x, *v: _fold(lambda a, b: F.array_append(a, b))(x, *v), "cons": lambda v, x: F.array_prepend(c(x), c(v)), "concat": lambda *x: F.concat(*map(c, x)), "list": lambda *x: F.array(*map(c, x)), "list*": lambda *x: F.concat(F.array(*map(c, x[:-1])), c(x[-1])),
    "vector": lambda *x: F.array(*map(c, x)), "vec": c, "seq": lambda x: F.when(F.size(c(x)) > 0, c(x)), "distinct": _seq(F.array_distinct), "flatten": _seq(F.flatten), "reverse": _seq(F.reverse), "rseq": _seq(F.reverse), "sort": _seq(F.array_sort),
    "dedupe": lambda x: F.filter(c(x), lambda v, i: (i == 0) | ~v.eqNullSafe(F.try_element_at(c(x), i))), "interleave": lambda a, b: F.flatten(F.zip_with(c(a), c(b), lambda p, q: F.array(p, q))), "interpose": lambda sep, x: F.slice(F.flatten(F.transform(c(x), lambda v: F.array(c(sep), v))), 2, 1 << 30),
    "partition": lambda n, x: F.transform(F.sequence(F.lit(0), F.floor(F.size(c(x)) / c(n)).cast("int") - 1), lambda i: F.slice(c(x), i * c(n).cast("int") + 1, c(n).cast("int"))),
    "partition-all": lambda n, x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(c(x)) / c(n)).cast("int") - 1), lambda i: F.slice(c(x), i * c(n).cast("int") + 1, c(n).cast("int"))),
    "range": lambda a, b=None, step=1: F.sequence(F.lit(0) if b is None else c(a), (c(a) if b is None else c(b)) - 1, c(step)), "repeat": lambda n, v: F.array_repeat(c(v), c(n).cast("int")), "replace": lambda x, a, b: F.replace(c(x), c(a), c(b)), "frequencies": _frequencies,
    # Sets.
    "set": _seq(F.array_distinct), "hash-set": lambda *x: F.array_distinct(F.array(*map(c, x))), "sorted-set": lambda *x: F.array_sort(F.array_distinct(F.array(*map(c, x)))), "contains?": _contains, "disj": lambda x, *v: _fold(lambda a, b: F.array_remove(a, b))(x, *v),
    "union": lambda *x: _fold(lambda a, b: F.array_union(a, b))(*x), "intersection": lambda *x: _fold(lambda a, b: F.array_intersect(a, b))(*x), "difference": lambda *x: _fold(lambda a, b: F.array_except(a, b))(*x),
    # Maps.
    "hash-map": lambda *x: F.create_map(*map(c, x)), "array-map": lambda *x: F.create_map(*map(c, x)), "zipmap": lambda k, v: F.map_from_arrays(c(k), c(v)), "get": _get, "get-in": lambda x, path, default=None: _get(_get(x, path[0]), path[1], default) if len(path) == 2 else _get(x, path[0], default),
    "keys": _seq(F.map_keys), "vals": _seq(F.map_values), "find": lambda x, k: F.when(F.map_contains_key(c(x), c(k)), F.array(c(k), F.try_element_at(c(x), c(k)))), "select-keys": lambda x, ks: F.map_filter(c(x), lambda k, _: k.isin([repr(v) if isinstance(v, Keyword) else v for v in ks])),
    "assoc": lambda x, k, v: F.map_concat(F.map_filter(c(x), lambda n, _: n != c(k)), F.create_map(c(k), c(v))), "dissoc": lambda x, *ks: F.map_filter(c(x), lambda n, _: ~n.isin([repr(v) if isinstance(v, Keyword) else v for v in ks])), "merge": lambda a, b: F.map_concat(F.map_filter(c(a), lambda k, _: ~F.map_contains_key(c(b), k)), c(b)),
    # Others.
    "identity": c, "-divide": lambda a, b: _quot(a, b), "-mod": _mod, "-like": lambda x, p: truthy(c(x).like(str(p))),
    # Time.
    "year": _seq(F.year), "month": _seq(F.month), "day": _seq(F.dayofmonth), "date-trunc": lambda unit, x: F.date_trunc(str(unit), c(x)),
}

#: Names that the reader may see but a set-oriented engine has no meaning for.
REFUSED = {
    "cycle": "it never ends", "transient": "there are no transients", "persistent!": "there are no transients", "assoc!": "there are no transients", "conj!": "there are no transients", "dissoc!": "there are no transients", "pop!": "there are no transients",
    **{name: "columns are immutable" for name in ("aset", "aset-boolean", "aset-byte", "aset-char", "aset-double", "aset-float", "aset-int", "aset-long", "aset-short")},
    **{name: "it takes a function" for name in ("update", "update-in", "max-key", "min-key", "sorted-set-by")},
}


def resolve(name: str, allowed: set[str] | None, extra: dict[str, Callable]) -> Callable[..., Column]:
    """The function of that name. allowed: what a configured list lets pass, besides the default ones; None lets all pass."""
    short = name.rsplit("/", 1)[-1] if len(name) > 1 else name
    if name in extra:
        if allowed is not None and "/" in name and name not in allowed and not any(name.startswith(f"{n}/") for n in allowed):
            raise ValueError(f"function {name} is not on the allow-list")
        return extra[name]
    if short in REFUSED:
        raise ValueError(f"function {name} is not supported: {REFUSED[short]}")
    if short not in REGISTRY:
        raise ValueError(f"unknown function {name}")
    if allowed is not None and "/" in name and len(name) > 1 and name not in allowed and name.rsplit("/", 1)[0] not in allowed and not name.startswith("clojure.core/"):
        raise ValueError(f"function {name} is not on the allow-list")
    return REGISTRY[short]
