"""Connect-style records in and out, and the formats in which results leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records_to_ops(records: DataFrame, id_key: str | None = None) -> DataFrame:
    """(op, eid, doc) of records (key, value): JSON values are put, null values delete. The id is the document's, a configured field's, the record's key, or new."""
    value = F.col("value")
    inner = F.coalesce(F.get_json_object(value, "$._id"), F.get_json_object(value, f"$.{id_key}") if id_key else F.lit(None).cast("string"), F.col("key"), F.uuid())
    return records.select(F.when(value.isNull(), "delete").otherwise("put").alias("op"), F.when(value.isNull(), F.col("key")).otherwise(inner).alias("eid"), value.alias("doc"))


def log_to_records(log: DataFrame, mode: str = "tx") -> DataFrame:
    """(key, value): one record for each transaction, or (mode doc) for each document it holds, as JSON."""
    if mode == "tx":
        return log.groupBy("tx_id").agg(F.min("tx_time").alias("tx_time"), F.sort_array(F.collect_list(F.struct("op_idx", "op", "eid", "doc"))).alias("ops")).select(F.col("tx_id").cast("string").alias("key"), F.to_json(F.struct("tx_id", "tx_time", "ops")).alias("value"))
    if mode == "doc":
        return log.where("op = 'put'").select(F.sha1(F.col("doc").cast("binary")).alias("key"), F.col("doc").alias("value"))
    raise ValueError(f"unknown mode {mode}")


def as_text(result: DataFrame, kind: str) -> DataFrame:
    """A result as lines: csv, tsv (with a first line of names), json, edn or html rows."""
    def cell(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    if kind == "json":
        return result.select(F.to_json(F.struct("*")).alias("value"))
    if kind in ("csv", "tsv"):
        sep = "," if kind == "csv" else "\t"
        quoted = [F.when(cell(c).rlike(f'["\n\r{sep}]'), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c)) for c in result.columns]
        head = result.sparkSession.createDataFrame([(sep.join(result.columns),)], "value string")
        return head.union(result.select(F.concat_ws(sep, *quoted).alias("value")))
    if kind == "edn":
        quoted = {c: F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('\\"')), F.lit('"')) if t == "string" else cell(c) for c, t in result.dtypes}
        return result.select(F.concat(F.lit("["), F.concat_ws(" ", *[F.when(F.col(f"`{c}`").isNull(), "nil").otherwise(q) for c, q in quoted.items()]), F.lit("]")).alias("value"))
    if kind == "html":
        return result.select(F.concat(F.lit("<tr>"), F.concat_ws("", *[F.concat(F.lit("<td>"), cell(c), F.lit("</td>")) for c in result.columns]), F.lit("</tr>")).alias("value"))
    raise ValueError(f"unknown format {kind}")
