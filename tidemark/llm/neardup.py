"""Near-duplicate documents: tensored MinHash banding, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import Workspace, only, over
from tidemark.llm.textkernel import SPACE, distinct, mix, shingles, text_slices, words

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Two collections of HALVES hashes, each of MINS minima. A table key pairs one of either: HALVES^2 tables from 2 * HALVES * MINS
#: minima instead of 2 * MINS * HALVES^2. A pair at similarity 0.75 shares no key with probability 2 * (1 - 0.75^3)^26 = 1.3e-6.
HALVES, MINS = 26, 3
#: Documents of a block in which unlinked pairs of one half key are compared.
BLOCK = 512

_rng = np.random.Generator(np.random.PCG64(97))
_MUL = (_rng.integers(1, 2**32, 2 * HALVES * MINS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, 2 * HALVES * MINS, dtype=np.uint64).astype(np.uint32)


def _sets(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in text_slices(column):
        hashes, first, _ = words(data, offsets, SPACE)
        values, at = distinct(*shingles(hashes, first, SHINGLE))
        yield row, values, at


def _sketch(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Half keys, a row for each nonempty set: u keys are even, v keys odd, and each holds its place."""
    starts = at[:-1][np.diff(at) > 0]
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 2 * HALVES), np.uint64)
    for h in range(2 * HALVES):
        key = np.full(len(starts), h + 1, np.uint64)
        for k in range(h * MINS, h * MINS + MINS):
            key = mix(key ^ np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts).astype(np.uint64))
        out[:, h] = (key & ~np.uint64(1)) | np.uint64(h >= HALVES)
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, values, at in _sets(batch.column(1)):
            n = np.diff(at)
            some = n > 0
            pair = np.zeros((2, len(n)), np.uint64)
            keys = np.zeros((0, 2 * HALVES), np.int64)
            if some.any():
                pair[0, some] = np.add.reduceat(values, at[:-1][some])
                pair[1, some] = np.add.reduceat(mix(values ^ np.uint64(0x5BF03635)), at[:-1][some])
                keys = _sketch(values, at)
            ends = np.concatenate([[0], np.cumsum(some) * 2 * HALVES]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(n)), pa.array(n), pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["node", "n", "print_a", "print_b", "halves"],
            )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, values, at in _sets(batch.column(1)):
            blob = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), pa.array(np.diff(at)), blob.cast(pa.binary())], names=["node", "n", "items"])


def _confirm(percent: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column(2), batch.column(3), []
            for k in range(len(batch)):
                a, b = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(nodes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of one block of a group that are in different components and, by their 64-bit shingles, similar enough; side: 0 in both halves, else 1 or 2, which meet each other only."""
    n = len(nodes)
    ok = (parts[:, None] != parts[None, :]) & (np.minimum(sizes[:, None], sizes[None, :]) * 100 >= percent * np.maximum(sizes[:, None], sizes[None, :]))
    ok &= np.triu(np.ones((n, n), bool), 1)
    if side.any():
        ok &= side[:, None] != side[None, :]
    left, right = np.nonzero(ok)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    many = count > 1
    column, owner = (np.cumsum(many) - 1)[column[many[column]]], owner[many[column]]
    both = np.zeros(len(left), np.int64)
    for start in range(0, int(column.max(initial=-1)) + 1 if len(left) else 0, 8192):
        here = (column >= start) & (column < start + 8192)
        bits = np.zeros((n, 8192), bool)
        bits[owner[here], column[here] - start] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(left), 16384):
            both[k : k + 16384] += np.bitwise_count(packed[left[k : k + 16384]] & packed[right[k : k + 16384]]).sum(axis=1, dtype=np.int64)
    total = sizes[left] + sizes[right]
    near = 100 * both >= percent * (total - both)
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    spanning = []
    for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True):
        a, b = top(i), top(j)
        if a != b:
            root[b] = a
            spanning.append((int(nodes[i]), int(nodes[j])))
    return spanning


def _across(percent: int) -> object:
    """Over rows sorted by (key, lo, hi): links between components among the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> list[tuple[int, int]]:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"].combine_chunks()]
            return _linked(rows["node"].to_numpy(), rows["part"].to_numpy(), rows["n"].to_numpy(), sets, rows["side"].to_numpy(), percent)

        rest: list[pa.Table] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(batch)]])
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                key = tuple(keys[a])
                if key != last and rest:
                    found += flush(pa.concat_tables(rest))
                    rest = []
                rest.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                last = key
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        if rest and (found := flush(pa.concat_tables(rest))):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Each row's (doc_id, n_shingles, component_id, kept).

    Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; a
    document's set holds its distinct five-word shingles, or its whole sequence if it is
    shorter. Two documents are linked if 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable; kept tells that it is the row's own.

    1. Equal sets are one class, by a 128-bit sum, and the smallest id stands for it.
    2. Half keys that one class has alone are dropped; the rest are tensored into table keys.
    3. In each bucket all are compared with the smallest (a star, not all pairs) and the links
       found give components.
    4. Exact rest: where documents of one u half key are still in different components, blocks
       of them are compared pair by pair within a task, which returns spanning links only.
    Links count only after their whole 64-bit shingle sets were compared.

    Null or wordless text: n_shingles 0, linked with nothing, its own component. Null id: component_id null, kept
    false, linked with nothing. Rows of the same id are one document; all are returned. Empty
    tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    marks = work.cut(over(docs, _signatures, "node long, n long, print_a long, print_b long, halves array<long>"), "marks")
    full = marks.where("n > 0 AND node IS NOT NULL")
    prints = ["print_a", "print_b", "n"]
    classes = work.cut(full.groupBy(*prints).agg(F.min("node").alias("rep"), F.first("halves").alias("halves")), "classes")

    half = classes.select(F.col("rep").alias("node"), F.explode("halves").alias("half"))
    # Such sums are tables of their own: joins with them have two shuffled sides, so hot keys are split, or broadcast what Spark finds small.
    common = work.cut(half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "common")
    shared = half.join(common, "half")
    even = F.col("half").bitwiseAND(F.lit(1)) == 0
    sides = shared.groupBy("node").agg(F.collect_set(F.when(even, F.col("half"))).alias("us"), F.collect_set(F.when(~even, F.col("half"))).alias("vs"))
    sides = work.cut(sides.where("size(us) > 0 AND size(vs) > 0"), "sides")
    keyed = sides.select("node", F.explode("us").alias("u"), "vs").select("node", "u", F.explode("vs").alias("v")).select("node", F.xxhash64("u", "v").alias("key"))
    buckets = work.cut(keyed.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("most")).where("rep < most").select("key", "rep"), "buckets")
    star = keyed.join(buckets, "key").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(docs, work.cut(star, "star"), work, percent)
    work.drop(common, buckets)

    # Rows of one id whose texts are in different classes.
    member = full.select("node", *prints).join(classes.select(*prints, "rep"), prints).select("node", "n", "rep")
    member = work.cut(member, "member")
    work.drop(classes)
    twice = member.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("node", "a")
    same = member.join(twice, "node").select("a", F.col("rep").alias("b")).distinct()
    links = work.cut(links.union(same), "links")
    parts = work.cut(connected_components(links, work), "parts")

    placed = sides.select("node", F.explode("us").alias("half")).join(parts, "node", "left").select("node", "half", F.coalesce("component", "node").alias("part"))
    placed = work.cut(placed, "placed")
    mixed = work.cut(placed.groupBy("half").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("half", "c"), "mixed")
    rest = work.cut(placed.join(mixed, "half"), "rest")
    sets = over(only(docs, rest.select("node").distinct(), "node"), _whole_sets, "node long, n long, items binary")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select(
        "half", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "part",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    joined = rest.join(sets, "node").select("half", "lo", "hi", "node", "part", "side", "n", "items")
    found = over(joined.repartition("half", "lo", "hi").sortWithinPartitions("half", "lo", "hi"), _across(percent), "a long, b long")
    more = _verified(docs, work.cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found"), work, percent)
    linked = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = connected_components(linked, work)

    near = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "n", F.coalesce("component", "rep").alias("component"))
    bare = marks.where("n = 0 OR node IS NULL").select("node", "n", F.col("node").alias("component"))
    out = near.union(bare)
    return out.select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("node") == F.col("component"), F.lit(False)).alias("kept"))


def _verified(docs: DataFrame, pairs: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough, in a table."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = over(only(docs, ids, "node"), _whole_sets, "node long, n long, items binary")
    sets = work.cut(sets.where("n > 0"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    links = work.cut(over(joined, _confirm(percent), "a long, b long").distinct(), "links")
    work.drop(sets, pairs)
    return links
