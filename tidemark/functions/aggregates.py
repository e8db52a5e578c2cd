"""Aggregates of a query's find clause. They see the bag of all assignments; no rows give no group."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _count_distinct(x: Column) -> Column:
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0))


def _same(x: Column) -> Column:
    return x


#: Name: function, literal arguments that it must have at least and may have at most.
AGGREGATES: dict[str, tuple[Callable[..., Column], int, int]] = {
    "count": (lambda x: F.count(F.lit(1)), 0, 0),
    "count-distinct": (_count_distinct, 0, 0),
    "sum": (F.sum, 0, 0),
    "avg": (F.avg, 0, 0),
    "median": (lambda x: F.median(x), 0, 0),
    "variance": (F.var_pop, 0, 0),
    "stddev": (F.stddev_pop, 0, 0),
    "distinct": (F.collect_set, 0, 0),
    "rand": (_same, 1, 1),
    "sample": (_same, 1, 1),
    "min": (F.min, 0, 1),
    "max": (F.max, 0, 1),
    "approx-count-distinct": (F.approx_count_distinct, 0, 0),
}


def _checked(name: str, literals: list) -> Callable[..., Column]:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}")
    make, low, high = AGGREGATES[name]
    if not low <= len(literals) <= high or not all(isinstance(v, int) and not isinstance(v, bool) for v in literals):
        raise ValueError(f"aggregate {name} takes {low} to {high} integer arguments before its variable")
    return make


def aggregate(name: str, literals: list, x: Column, extra: dict[str, Callable[..., Column]]) -> Column:
    if name in extra:
        return extra[name](x, *literals)
    return _checked(name, literals)(x)


def keeps_some(name: str, literals: list, extra: dict[str, Callable[..., Column]]) -> bool:
    """Whether the aggregate gives n of a group's values, which `some_values` finds without holding a group whole."""
    return name in ("min", "max", "rand", "sample") and name not in extra and bool(literals) and bool(_checked(name, literals))


def some_values(rows: DataFrame, by: list[str], value: str, name: str, n: int) -> DataFrame:
    """(by, value: an array) of each group that has values: the least, the greatest or any n distinct ones, or n drawn with repeats by their counts.

    Values are made distinct by (group, value) first, so no task meets a hot group's rows; then
    each task passes on n a group. Draws come from hashes under a salt of the plan, so a task that
    runs again draws the same.
    """
    keys = [F.col(f"`{k}`") for k in by]
    x, salt = F.col(f"`{value}`"), F.lit(secrets.randbits(62))
    seen = rows.where(x.isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__count"))
    if name == "rand":
        # Of exponential clocks at the values' counts as rates, the first to ring is each with its share of the rows.
        uniform = [(F.pmod(F.xxhash64(x, salt, F.lit(k)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52)) for k in range(max(n, 1))]
        draws = [F.min_by(x, -F.log(u) / F.col("__count")) for u in uniform]
        return seen.groupBy(*keys).agg(F.slice(F.array(*draws), 1, n).alias(value))
    order = {"min": x.asc(), "max": x.desc(), "sample": F.xxhash64(x, salt).asc()}[name]
    best = seen.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("__place") <= n)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias(value))
