import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, token_orc
from tidemark.llm.shared import Workspace
from tidemark.llm.textkernel import text_slices

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)


def ids_of(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(ids_of(t), "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, make_docs, odd_rows):
    path = Workspace(spark, "test").folder("orc")
    token_orc.write_tokens(make_docs(odd_rows), path, PATH, 2)
    read = token_orc.read_tokens(spark, path)
    got = [tuple(r) for r in token_orc.token_digest(read).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(odd_rows)
    assert [r["ids"] for r in read.where("doc_id = 6").collect()] == [ids_of("one two")]
    assert "doc_id" in read.where("doc_id = 6")._jdf.queryExecution().toString().split("PushedFilters")[1][:80]


def test_empty_table(spark, make_docs):
    path = Workspace(spark, "test").folder("orc")
    token_orc.write_tokens(make_docs([]), path, PATH, 2)
    assert token_orc.token_digest(token_orc.read_tokens(spark, path)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abZ'sre <|>\n\t\x1c\x85\xa0éÀßÿ×ª中½1İΣ") + ["<|endoftext|>", "́", "　"]), max_size=20).map("".join))
def test_words_between_white_space(text):
    assert np.frombuffer(token_orc.WordEncoder(PATH).text(text), "<u4").tolist() == MODEL.encode(text, add_special_tokens=False).ids


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op2_orc_token_output(spark, sf).collect())
    assert got == sorted(expected(rows))


def test_files_follow_each_other_by_part_number(spark):
    """A part number of six digits sorts before some of five by name."""
    files = [("part-00000-x.orc", 3), ("part-00002-x.orc", 1), ("part-10001-x.orc", 4), ("part-100000-x.orc", 5), ("part-100001-x.orc", 2)]
    rows = [(k, 0, n, [7] * n, f) for k, (f, n) in enumerate(files)]
    tokens = spark.createDataFrame(rows[::-1], "doc_id long, start_in_file long, n_tokens long, ids array<int>, file string")
    assert sorted((r["doc_id"], r["start"]) for r in token_orc.token_digest(tokens).collect()) == [(0, 0), (1, 3), (2, 4), (3, 8), (4, 13)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(list("abZ'srevlmtd <|>\n\x0b\x1c\xa0éÀßÿ×ª中½1Σ''  ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "́", "　"]), max_size=12).map("".join), max_size=6), st.integers(1, 12))
def test_rows_that_are_cut_into_runs(rows, run):
    """Rows and runs of words end anywhere among the bytes that are encoded at once."""
    kept, token_orc.RUN_BYTES = token_orc.RUN_BYTES, run
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])
        got = [r for b in token_orc._encode(PATH, 2)(iter([batch, batch.slice(1)])) for r in b.to_pylist()]
    finally:
        token_orc.RUN_BYTES = kept
    ids = [ids_of(t) for t in [*rows, *rows[1:]]]
    assert [r["ids"] for r in got] == ids
    assert [(r["start_in_file"], r["n_tokens"]) for r in got] == [(sum(map(len, ids[:k])), len(ids[k])) for k in range(len(ids))]


def test_each_part_is_looked_up_once_a_batch():
    """Not once a word: looking up each occurrence, and encoding words again with other signs and cases, took most of the time."""
    texts = ["Word, WORD; it's (word) -- naïve"] * 700
    encoder, asked = token_orc.WordEncoder(PATH), []

    class Asked(dict):
        def __getitem__(self, unit):
            asked.append(unit)
            return encoder._unit(unit)

    encoder.kept = Asked()
    for _, data, offsets in text_slices(pa.array(texts)):
        ids, counts = encoder.rows(data, offsets)
    assert sorted(asked) == sorted(p.encode() for p in ["word", ",", ";", "it", "'s", "(", ")", "--", "naïve"])
    assert np.split(ids, np.cumsum(counts)[:-1])[-1].tolist() == MODEL.encode(texts[0], add_special_tokens=False).ids


def test_long_units_are_not_kept():
    encoder = token_orc.WordEncoder(PATH)
    text = "中文" * 5000 + " short " + "x" * 5000
    assert np.frombuffer(encoder.text(text), "<u4").tolist() == MODEL.encode(text, add_special_tokens=False).ids
    assert set(encoder.kept) == {b"short"}
