"""The registered queries of the operators: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, binpack, bpe, chat, decontam, licenses, neardup, token_orc, toxicity, warc
from tidemark.llm.shared import Workspace, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of the benchmark, one row for each item."""
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_orc_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").folder("orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), end_id=2)
    return token_orc.token_digest(token_orc.read_tokens(spark, path))


def op3_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack(table(spark, sf_dir, "documents"), shards=40)


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.collapse(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seed_decontamination, op2_orc_token_output, op3_weak_supervision_toxicity, op4_vector_bin_packing, op5_tensored_minhash,
        op6_multi_index_hashing, op7_license_dice, op8_distinct_word_bpe, op9_warc_writer, op10_snapshot_collapse,
    )
}

#: DuckDB SQL of those whose result SQL can express.
SQL = {
    "op5_tensored_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(node, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT node, b FROM r JOIN l ON reached = a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN c ON node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op9_warc_writer": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_page FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT)) AS fives FROM r)
SELECT page_id, octet_length(body) AS payload_bytes, array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM b""",
    "op10_snapshot_collapse": """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations),
h AS (SELECT *, sha256(concat(place, chr(31), coalesce(role, chr(30)), chr(31), coalesce(text, chr(30)))) AS one FROM t),
x AS (SELECT conv_id, place, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM h),
e AS (SELECT min(conv_id) AS conv_id, n_turns, sha256(prefix) AS k FROM x WHERE place = n_turns - 1 GROUP BY ALL),
m AS (SELECT conv_id, n_turns FROM e WHERE k NOT IN (SELECT sha256(prefix) FROM x WHERE place < n_turns - 1))
SELECT m.conv_id, CAST(place // 1000 AS INTEGER) AS segment, m.n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM m JOIN t ON t.conv_id = m.conv_id GROUP BY m.conv_id, place // 1000, m.n_turns""",
}
