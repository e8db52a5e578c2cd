"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents with benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, neardup, toxicity
from tidemark.llm.shared import BROADCAST_ROWS, Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5; null and empty texts stay. The model learns from the labelled rows among docs."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"toxicity_{k}") not in docs.columns)
    return toxicity.score(docs, model, name).where(f"{name} < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows without id or words are linked with nothing and stay; of rows that share an id the one stays whose text, then whose other columns in order, are smallest."""
    found = Workspace(spark, "pipeline").cut(neardup.near_duplicates(docs), "found")
    gone = found.where("NOT kept AND doc_id IS NOT NULL AND component_id IS NOT NULL").select("doc_id").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    order = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    first = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row_of_id")).select("doc_id", "row_of_id.*").select(docs.columns)
    return first.union(kept.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every row."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]

#: Neither the classifier nor the tokenizer can be expressed; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
