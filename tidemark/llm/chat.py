"""Chat formatting: snapshots of growing conversations collapse to the longest, which are rendered. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace

#: Turns of a rendered segment; a longer conversation has several, so no row holds an unbounded one.
SEGMENT_TURNS = 1000


def collapse(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns (conv_id, place from 0, role, text) of maximal conversations: those that no other conversation continues or, with a smaller id, repeats.

    Each turn is hashed with its place, role and text; running sums of the hashes identify every
    prefix. Turns are put in ranges by (conversation, turn) first and summed within them, then
    across them, so a conversation of any length is shared by tasks. Ends of conversations that
    are equal meet once, and an anti-join with the proper prefixes of all keeps the maximal.

    Order is by turn, then role and text; nulls come first and count as values of their own, so
    they equal each other only. A null conv_id is one conversation. Repeated rows are turns of
    their own. Empty texts are kept. Empty tables: no rows. Other columns are ignored.
    """
    work = Workspace(conversations.sparkSession, "chat")
    columns = [F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")]
    order = ["conv_id", "turn", "role", "text"]
    # Bounds of the ranges are sampled to the driver: the start of a text will do for them, since it sorts as the text does.
    ranged = conversations.select(*columns).repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    turns = work.cut(ranged.withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "turns")
    own = W.partitionBy("conv_id", "range").orderBy("row")
    here = turns.groupBy("conv_id", "range").agg(F.count("*").alias("c"))
    base = here.withColumn("base", F.sum("c").over(W.partitionBy("conv_id").orderBy("range")) - F.col("c")).select(F.col("conv_id").alias("k"), F.col("range").alias("r"), "base")
    placed = turns.withColumn("nth", F.row_number().over(own)).join(base, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")))
    placed = placed.withColumn("place", F.col("base") + F.col("nth") - 1)
    parts = [F.coalesce(F.col("role"), F.lit("")), F.col("role").isNull(), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()]
    hashes = [F.xxhash64(F.lit(seed), "place", *parts).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
    hashed = work.cut(placed.select("conv_id", "range", "row", "place", "role", "text", *hashes), "hashed")
    sums = hashed.groupBy("conv_id", "range").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    across = W.partitionBy("conv_id").orderBy("range")
    ahead = sums.select(F.col("conv_id").alias("k"), F.col("range").alias("r"), *[(F.sum(f"s{i}").over(across) - F.col(f"s{i}")).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)])
    thin = hashed.select("conv_id", "range", "place", "row", *[F.sum(f"h{i}").over(own).cast("decimal(38,0)").alias(f"l{i}") for i in (1, 2)])
    prefixes = thin.join(ahead, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")))
    prefixes = prefixes.select("conv_id", "place", *[(F.col(f"l{i}") + F.col(f"b{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)])
    prefixes = work.cut(prefixes, "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("last")).select(F.col("conv_id").alias("k"), "last")
    marked = prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("k")))
    key = ["place", "p1", "p2"]
    ends = marked.where("place = last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("place < last").select(*key).distinct()
    maximal = ends.join(inner, key, "left_anti").select(F.col("conv_id").alias("k"), (F.col("place") + 1).alias("n_turns"))
    return hashed.join(maximal, F.col("conv_id").eqNullSafe(F.col("k"))).select("conv_id", "place", "n_turns", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, rendered): `<|im_start|>role`, the text and `<|im_end|>` of each turn, a line break after each; SEGMENT_TURNS turns a row.

    A null role is `unknown`, a null text empty.
    """
    one = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = turns.select("conv_id", "n_turns", F.floor(F.col("place") / SEGMENT_TURNS).cast("int").alias("segment"), F.struct("place", one.alias("said")).alias("turn"))
    grouped = rows.groupBy("conv_id", "n_turns", "segment").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", "segment", "n_turns", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("rendered"))
