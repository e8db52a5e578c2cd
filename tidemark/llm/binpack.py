"""Vector bin packing of documents into shards: bytes, tokens and rows balanced jointly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace, give_back, words_of

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Groups that one task places, about; more are dealt to cells by hash, and each cell fills the same share of every shard.
CELL_GROUPS = 20_000
#: A level has at most so many times the cells of the level above it.
CELL_FACTOR = 64
#: A group over one such part of what a cell puts into a shard, in any dimension, belongs to a level above; over that part of a shard it is cut into pieces.
HEAVY_PART = 4
#: Pieces are that part of a shard, so that what a count of them can't even out is small.
PIECE_PART = 64
#: Rows of a run of slots that are numbered together.
SLOT_ROWS = 5000

_DIMENSIONS = ["bytes", "tokens", "rows"]


def place(sizes: np.ndarray, left: np.ndarray, order: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each unit (rows of `sizes`: one column a dimension), in the given order: that with the highest dot product of the unit and `left`, what remains of each shard's capacity; ties go to the first shard from `turn` on."""
    left = np.roll(left, -turn, axis=0)
    out = np.zeros(len(sizes), np.int32)
    for k in order.tolist():
        size = sizes[k]
        out[k] = best = int((left @ size).argmax())
        left[best] -= size
    return (out + turn) % len(left)


def _cell(left: np.ndarray, totals: np.ndarray) -> object:
    """Places the units of one cell, largest first, into the cell's part of what is left of a level."""

    def run(units: pa.Table) -> pa.Table:
        sizes = np.stack([units[d].to_numpy().astype(np.float64) for d in _DIMENSIONS], axis=1) / totals
        keys = [units[c].to_numpy() for c in ("group_hash", "piece", "size", "text_crc32")]
        shards = place(sizes, left * sizes.sum(axis=0), np.lexsort((*keys, -sizes.max(axis=1))), int(units["cell"][0].as_py()) % len(left))
        give_back()
        return units.drop_columns(["cell"]).append_column("shard", pa.array(shards, pa.int32()))

    return run


def levels(groups: int) -> list[int]:
    """Cells of each level, the first with one."""
    cells = max(1, math.ceil(groups / CELL_GROUPS))
    out = [1]
    while out[-1] < cells:
        out.append(min(out[-1] * CELL_FACTOR, cells))
    return out


def pack(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens) of every row; the law is `bytes`: shards' sizes are near equal.

    Equal texts are a group and stay together, unless the group exceeds a quarter of a shard:
    then its rows are numbered and cut into pieces of equal counts, whatever their ids. Groups
    are summed before anything is placed. Large ones are placed first, in one task; the others by
    levels of size, each level in cells of a hash that a task can hold, every cell by the same
    rule into its part of what the levels before have left of each shard. The driver sees sums by
    shard only. Slots number a shard's rows from 0 without gaps, by runs of about SLOT_ROWS rows,
    so no task holds a shard.

    Null text: 16 bytes, no tokens, the CRC of nothing; it groups with empty texts. Null and
    repeated ids are placed as any row. An empty table gives no rows. grown_shard is null (the
    law `key` alone has it). Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "binpack")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The number of a row is kept with it, so that it stays when a task runs again.
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), words_of(text).alias("n_tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group_hash"), F.monotonically_increasing_id().alias("row"),
    )
    thin = work.cut(thin, "thin")
    key = ["group_hash", "text_crc32", "size"]
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = work.cut(thin.groupBy(*key).agg(*sums), "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _DIMENSIONS], F.count("*").alias("groups")).first()
    # How many quarters of a shard a group fills.
    quarters = F.greatest(*[F.col(c) * F.lit(shards * HEAVY_PART / max(total[c], 1)) for c in _DIMENSIONS])
    heavy = groups.where(quarters > 1).withColumn("pieces", F.ceil(quarters * (PIECE_PART // HEAVY_PART))).select(*key, F.col("rows").alias("n"), "pieces")
    # At most 3 * shards * HEAVY_PART groups are that large.
    heavy = F.broadcast(work.cut(heavy, "heavy"))
    upto = lambda i: F.expr(f"({i} * n + pieces - 1) div pieces")
    pieces = groups.join(heavy, key).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    pieces = pieces.withColumn("part", upto("(piece + 1)") - upto("piece")).select(*key, "piece", *[F.expr(f"{c} div rows * part").alias(c) for c in _DIMENSIONS])

    cells = levels(total["groups"])
    placed, held, filled = [], np.zeros((shards, 3)), np.zeros(3)
    for k, count in enumerate(cells):
        units = groups.where(quarters <= 1 / count) if k else groups.where(quarters <= 1)
        if k + 1 < len(cells):
            units = units.where(quarters > 1 / cells[k + 1])
        units = units.select(*key, F.lit(-1).cast("long").alias("piece"), *_DIMENSIONS)
        units = units if k else units.unionByName(pieces)
        sizes = units.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _DIMENSIONS]).first()
        here = np.array(sizes, np.float64)
        filled += here
        here = np.maximum(here, 1)
        left = (filled / shards - held) / here
        cell = F.pmod(F.xxhash64(*key, F.lit(k)), F.lit(count)).cast("int") if count > 1 else F.lit(0)
        schema = f"{', '.join(f'{c} long' for c in (*key, 'piece', *_DIMENSIONS))}, shard int"
        made = work.cut(units.withColumn("cell", cell).groupBy("cell").applyInArrow(_cell(left, here), schema), "placed")
        for r in made.groupBy("shard").agg(*[F.sum(c).alias(c) for c in _DIMENSIONS]).collect():
            held[r["shard"]] += [r[c] for c in _DIMENSIONS]
        placed.append(made)

    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    columns = ["doc_id", "size", "n_tokens", "text_crc32", "row", "shard"]
    light = thin.join(whole.where("piece < 0").select(*key, "shard"), key).select(*columns)
    large = _numbered(thin.join(heavy, key), key).withColumn("piece", F.expr("number * pieces div n"))
    large = large.join(F.broadcast(placed[0].where("piece >= 0").select(*key, "piece", "shard")), [*key, "piece"]).select(*columns)
    runs = max(1, int(total["rows"]) // (SLOT_ROWS * shards))
    rows = work.cut(light.unionByName(large).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs))), "rows")
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("c"))
    before = counts.select("shard", "run", (F.sum("c").over(W.partitionBy("shard").orderBy("run")) - F.col("c")).alias("base"))
    nth = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "row"))
    out = rows.withColumn("nth", nth).join(before, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their `number` among those of their key, from 0: by the input partitions that wrote them, so that no task holds a key."""
    part: Column = F.shiftright("row", 33)
    rows = rows.withColumn("part", part)
    counts = rows.groupBy(*key, "part").agg(F.count("*").alias("c"))
    before = counts.select(*key, "part", (F.sum("c").over(W.partitionBy(*key).orderBy("part")) - F.col("c")).alias("base"))
    nth = F.row_number().over(W.partitionBy(*key, "part").orderBy("row"))
    return rows.withColumn("nth", nth).join(before, [*key, "part"]).withColumn("number", F.col("base") + F.col("nth") - 1)
