"""Bitemporal operators: versions (eid, vt, tt, tx_id, content_hash; a null hash is a deletion) as of a point in both times, and their history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(versions: DataFrame, valid_time: datetime | Column | None = None, tx_id: int | None = None, key: str = "eid", payload: list[str] | None = None, alive: str | None = None) -> DataFrame:
    """The version of each key that holds: the largest (vt, tx_id) not after the basis. Deleted ones (`alive` null) go.

    One hash aggregation, partial before the shuffle: no sort, no window.
    """
    rows = versions
    if valid_time is not None:
        rows = rows.where(F.col("vt") <= (valid_time if isinstance(valid_time, Column) else F.lit(valid_time)))
    if tx_id is not None:
        rows = rows.where(F.col("tx_id") <= tx_id)
    payload = payload or [c for c in versions.columns if c not in (key, "vt", "tx_id")]
    best = rows.groupBy(key).agg(F.max_by(F.struct("vt", "tx_id", *payload), F.struct("vt", "tx_id")).alias("v"))
    out = best.select(key, "v.*")
    return out.where(F.col(alive).isNotNull()) if alive else out


def history(versions: DataFrame, descending: bool = False, start: tuple | None = None, end: tuple | None = None, corrections: bool = False, key: str = "eid") -> DataFrame:
    """Versions of each key in order of valid time; start bounds (vt, tx_id) are inclusive, end bounds exclusive, None leaves a side open.

    Of versions with one valid time the last recorded stays, unless corrections are wanted.
    """
    rows = versions
    low, high = (end, start) if descending else (start, end)
    if low is not None:
        op = (lambda c, v: c > v) if descending else (lambda c, v: c >= v)
        for column, value in zip(("vt", "tx_id"), low, strict=False):
            rows = rows.where(op(F.col(column), F.lit(value))) if value is not None else rows
    if high is not None:
        op = (lambda c, v: c <= v) if descending else (lambda c, v: c < v)
        for column, value in zip(("vt", "tx_id"), high, strict=False):
            rows = rows.where(op(F.col(column), F.lit(value))) if value is not None else rows
    if not corrections:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, "vt").orderBy(F.desc("tx_id")))).where("__n = 1").drop("__n")
    return rows.orderBy(key, F.desc("vt"), F.desc("tx_id")) if descending else rows.orderBy(key, "vt", "tx_id")


def layout(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Versions laid out for point reads: ranges of eid, sorted by (eid, vt, tx_id), so that files are skipped by their statistics."""
    ranged = versions.repartitionByRange(partitions, "eid") if partitions else versions.repartitionByRange("eid")
    return ranged.sortWithinPartitions("eid", "vt", "tx_id")


def fold_put(existing: list[tuple], start: datetime, end: datetime | None, tt: datetime, tx_id: int, content: str | None) -> list[tuple]:
    """The versions (vt, tt, tx_id, content) that a put (or, with content None, a delete) adds to one entity's.

    With an end the new content holds from start to end, and what held at the end is restored
    there (a deletion, if nothing did). Without, it holds to the end of the version that was
    visible at start, or to the next version if none was.
    """

    def visible(at: datetime) -> tuple | None:
        rows = [v for v in existing if v[0] <= at]
        return max(rows, key=lambda v: (v[0], v[2])) if rows else None

    if end is not None:
        if start >= end:
            return []
        inner = sorted({v[0] for v in existing if start < v[0] < end})
        out = [(t, tt, tx_id, content) for t in [start, *inner]]
        after = visible(end)
        out.append((end, *after[1:]) if after else (end, tt, tx_id, None))
        return out
    before = visible(start)
    out = [(start, tt, tx_id, content)]
    if before is not None and before[3] is not None:
        for t in sorted({v[0] for v in existing if v[0] > start}):
            here = visible(t)
            if here is None or here[1:] != before[1:]:
                break
            out.append((t, tt, tx_id, content))
    return out
