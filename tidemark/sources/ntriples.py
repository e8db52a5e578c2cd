"""N-Triples: lines to facts, facts to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_LITERAL = r'^"((?:[^"\\]|\\.)*)"'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, kind, lang): kind is iri, blank, string or the local name of the literal's type; comments and broken lines are left out."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    line = F.col(column)
    rows = lines.where(line.rlike(_LINE)).select(*[F.regexp_extract(line, _LINE, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    text = F.regexp_extract("o", _LITERAL, 1)
    for code, char in (('\\\\"', '"'), ("\\\\n", "\n"), ("\\\\t", "\t"), ("\\\\r", "\r"), ("\\\\\\\\", "\\\\")):
        text = F.regexp_replace(text, code, char)
    kind = F.regexp_extract("o", r"\^\^<[^>]*[#/]([^#/>]+)>$", 1)
    return rows.select(
        strip(F.col("s")).alias("s"), "p",
        F.when(F.col("o").startswith('"'), text).otherwise(strip(F.col("o"))).alias("o"),
        F.when(F.col("o").startswith("<"), "iri").when(F.col("o").startswith("_:"), "blank").when(kind != "", kind).otherwise("string").alias("kind"),
        F.nullif(F.regexp_extract("o", r"@([A-Za-z-]+)$", 1), F.lit("")).alias("lang"),
    )


def documents(facts: DataFrame, attributes: list[str]) -> DataFrame:
    """One row for each subject with an array of values for each attribute; attributes are whole predicates."""
    wanted = facts.where(F.col("p").isin(attributes))
    return wanted.groupBy(F.col("s").alias("eid")).pivot("p", attributes).agg(F.collect_set("o"))
