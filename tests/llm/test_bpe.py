import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)


def brute(text):
    ids = MODEL.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), MODEL.decode(ids, skip_special_tokens=False)


def test_matches_the_library(make_docs, odd_rows):
    got = bpe.encode_decode(make_docs(odd_rows), PATH).collect()
    want = sorted(((i, *brute(t)) for i, t in odd_rows), key=str)
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got), key=str) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_many_chunks(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 200)
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows * 3)]
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_decode(make_docs(rows), PATH).collect()}
    assert got == {i: brute(t)[0] for i, t in rows}


def test_empty_table(make_docs):
    assert bpe.encode_decode(make_docs([]), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sre <|>\n\t\r\x1c\x85\xa0é中1") + ["<|endoftext|>", "  ", " "]), max_size=24).map("".join))
def test_words_join_to_the_text(text):
    words = [w[1:] if w[:1] == bpe._FIRST else " " + w for w in bpe.split_words(text, bpe._specials(PATH))]
    assert "".join(words) == text
    assert [i for w in words for i in MODEL.encode(w, add_special_tokens=False).ids] == MODEL.encode(text, add_special_tokens=False).ids


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op8_distinct_word_bpe(spark, sf).collect():
        ids, text = brute(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_a_bucket_of_more_words_than_are_kept(make_docs, odd_rows, monkeypatch):
    want = sorted(map(tuple, bpe.encode_decode(make_docs(odd_rows), PATH).collect()), key=str)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 1)
    assert sorted(map(tuple, bpe.encode_decode(make_docs(odd_rows), PATH).collect()), key=str) == want
