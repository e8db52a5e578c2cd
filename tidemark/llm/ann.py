"""Nearest neighbours by multi-index hashing: learned rotated binary codes, substring tables, pigeonhole probing, float reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace, give_back, over

#: Vectors, at most, that rotations, substrings and radii are fitted on, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 6000, 400
#: Share of the sample's neighbours that probing must find, and share of those that the radius over the whole code must keep.
TARGET, KEEP = 0.95, 0.99
#: Bits of a code, at most: as many learned rotations as that takes.
MOST_BITS = 512
#: Rows of an index block and queries of a query block, at most; a small table has more blocks, of LEAST_BLOCK rows at least, so that all cores have one.
BLOCK, QUERIES, LEAST_BLOCK = 131072, 65536, 4096
#: What looking up a bucket costs, where visiting a row costs 1.
PROBE_COST = 1.5


@dataclass(frozen=True)
class Codes:
    """Codes of `tables` substrings of `bits` bits. Probing all values within `near` bits of each finds every code within the Hamming radius of tables * (near + 1) - 1, and others; those within `radius` are reranked."""

    centre: np.ndarray
    rotation: np.ndarray
    tables: int
    bits: int
    near: int
    radius: int

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(substrings of each row, whole codes as 64-bit words)."""
        width = self.tables * self.bits
        values = np.empty((len(vectors), self.tables), np.int32)
        whole = np.zeros((len(vectors), -(-width // 64) * 64), bool)
        powers = (1 << np.arange(self.bits)).astype(np.float32)
        for k in range(0, len(vectors), 8192):
            signs = (vectors[k : k + 8192] - self.centre) @ self.rotation > 0
            whole[k : k + 8192, :width] = signs
            values[k : k + 8192] = signs.reshape(-1, self.bits).astype(np.float32).dot(powers).reshape(-1, self.tables)
        return values, np.packbits(whole, axis=1).view(np.uint64)


def _turns(sample: np.ndarray, width: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centre and `width` directions: rotations from different starts, each turned so that signs lose least."""
    dim = sample.shape[1]
    centre = sample.mean(axis=0)
    x = sample - centre
    rng = np.random.default_rng(11)
    out = []
    for _ in range(-(-width // dim)):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ w).T
        out.append(turn)
    return centre, np.hstack(out)[:, :width]


def fit(sample: np.ndarray, k: int, rows: int, block: int) -> Codes:
    """Learned rotations, and the substrings that find TARGET of the neighbours at the least cost in a block of `block` rows.

    A neighbour of rank r among all `rows` is, in a sample, of rank r * sample / rows: those
    neighbours within the sample stand for the k nearest of all. If no substrings reach TARGET
    the tables have one bucket's reach, which is all rows.
    """
    width = MOST_BITS
    centre, rotation = _turns(sample, width)
    everything = Codes(centre, rotation[:, :8], 1, 8, 8, 8)
    some = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
    inner = sample[some] @ sample.T
    inner[np.arange(len(some)), some] = -np.inf
    k = min(max(1, math.ceil(k * len(sample) / rows)), len(sample) - 1)
    if k < 1:
        return everything
    top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
    signs = (sample - centre) @ rotation > 0
    apart = signs[some][:, None, :] ^ signs[top]
    best, least = everything, 256 * PROBE_COST + block
    for bits in range(8, 21, 2):
        many = width // bits
        gaps = apart[:, :, : many * bits].reshape(-1, many, bits).sum(axis=2)
        for near in range(5):
            ball = sum(math.comb(bits, i) for i in range(near + 1))
            found = np.maximum.accumulate(gaps <= near, axis=1).mean(axis=0)
            if found[-1] < TARGET:
                continue
            tables = int(np.argmax(found >= TARGET)) + 1
            cost = tables * ball * PROBE_COST + (1 - (1 - ball / 2**bits) ** tables) * block
            if cost < least:
                radius = int(np.ceil(np.quantile(gaps[:, :tables].sum(axis=1)[(gaps[:, :tables] <= near).any(axis=1)], KEEP)))
                best, least = Codes(centre, rotation[:, : tables * bits], tables, bits, near, radius), cost
    return best


class Tables:
    """A table for each substring of a block's codes: its bucket holds the rows with that value."""

    def __init__(self, codes: Codes, values: np.ndarray, whole: np.ndarray) -> None:
        self.codes, self.whole, self.rows = codes, whole, len(values)
        buckets = 1 << codes.bits
        self.order = np.concatenate([np.argsort(v, kind="stable") for v in values.T]).astype(np.int32)
        ends = [np.cumsum(np.bincount(v, minlength=buckets)) for v in values.T]
        self.starts = np.concatenate([np.concatenate([[0], e]) + j * self.rows for j, e in enumerate(ends)])
        every = np.arange(buckets, dtype=np.int64)
        self.flips = every[np.bitwise_count(every) <= codes.near]
        self.shift = np.arange(codes.tables, dtype=np.int64)[:, None] * (buckets + 1)
        self.seen = np.zeros(self.rows, bool)

    def probed(self, values: np.ndarray) -> np.ndarray:
        """Rows of all buckets within `near` bits of a query's substrings."""
        at = ((self.flips[None, :] ^ values[:, None]) + self.shift).ravel()
        lo = self.starts[at]
        count = self.starts[at + 1] - lo
        some = count > 0
        lo, count = lo[some], count[some]
        self.seen[self.order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]] = True
        rows = np.flatnonzero(self.seen)
        self.seen[rows] = False
        return rows

    def near(self, values: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Probed rows whose whole code is within the radius."""
        rows = self.probed(values)
        if self.codes.near >= self.codes.bits:
            return rows
        return rows[np.bitwise_count(self.whole[rows] ^ code).sum(axis=1, dtype=np.int64) <= self.codes.radius]


def _search(codes: Codes, k: int) -> object:
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        ids = index["vec_id"].to_numpy()
        if len(ids) and queries.num_rows:
            vectors = _matrix(index["vector"])
            tables = Tables(codes, *codes.encode(vectors))
            q_ids, q = queries["query_id"].to_numpy(), _matrix(queries["vector"])
            for query, vector, values, code in zip(q_ids.tolist(), q, *codes.encode(q), strict=True):
                rows = tables.near(values, code)
                rows = rows[ids[rows] != query]
                if len(rows) < k:
                    rows = np.flatnonzero(ids != query)
                near = vectors[rows] @ vector
                if len(rows) > k:
                    least = np.partition(near, len(near) - k)[len(near) - k]
                    rows = rows[near >= least - 1e-9 * max(1.0, abs(least))]
                exact = np.array([float(np.multiply(vectors[r], vector).sum()) for r in rows.tolist()])
                best = np.lexsort((ids[rows], -exact))[:k]
                out[0] += [query] * len(best)
                out[1] += ids[rows[best]].tolist()
                out[2] += exact[best].tolist()
        found = pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})
        give_back()
        return found

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _usable(id_name: str) -> object:
    """Vectors as bytes of doubles, with their norm; rows whose vector is null, empty, zero or holds a null or a non-finite number go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs, sizes = [], [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(key), blobs.append(x.tobytes()), sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int32())], names=[id_name, "vector", "size"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` with the largest inner product, the query's own id apart.

    Rotations, substrings and radius are fitted on at most SAMPLE_ROWS vectors; every vector is
    coded and indexed in blocks, and each query visits the tables of every block: pigeonhole
    probing of all substrings finds every code within a Hamming radius, codes within the fitted
    radius are scored in double precision on the original vectors, and a block returns its k best
    (a query that finds fewer in a block looks at all of it). Best first; ties go to the smaller
    id. Recall is fitted to TARGET * KEEP; tests measure it against brute force. The index is
    shuffled once for each QUERIES queries, the queries once for each BLOCK rows; the k best of
    each query are picked by a limit that is applied before that shuffle too.

    Null ids and vectors that are null, empty, zero or hold a null or non-finite number take no
    part; nor do vectors of another length than most. Fewer than k candidates: all. Empty
    tables: no rows. Repeated ids are separate candidates, none of them for a query of that id;
    of repeated query ids the one with the smallest vector, as bytes, asks. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = work.cut(over(pick(vectors), _usable("vec_id"), "vec_id long, vector binary, size int"), "vectors")
    schema = "query_id long, vec_id long, score double"
    sizes = base.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.where(F.col("size") == sizes["size"]).select("vec_id", "vector")
    asked = over(pick(queries), _usable("query_id"), "query_id long, vector binary, size int").where(F.col("size") == sizes["size"])
    asked = work.cut(asked.groupBy("query_id").agg(F.min("vector").alias("vector")), "queries")
    part = min(1.0, SAMPLE_ROWS / sizes["c"])
    sample = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < part * (1 << 30)).limit(2 * SAMPLE_ROWS).select("vector").collect()
    blocks = max(-(-sizes["c"] // BLOCK), min(spark.sparkContext.defaultParallelism, sizes["c"] // LEAST_BLOCK), 1)
    groups = max(1, -(-asked.count() // QUERIES))
    codes = fit(np.stack([np.frombuffer(r["vector"], np.float64) for r in sample]) if sample else np.ones((1, sizes["size"])), k, sizes["c"], -(-sizes["c"] // blocks))
    index = base.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    probes = asked.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = probes.groupBy("group", "block").cogroup(index.groupBy("group", "block")).applyInArrow(_search(codes, k), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
