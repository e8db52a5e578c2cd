"""BPE over a distinct-word table: split, encode each distinct word once, join ids back by position, decode by id."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace, give_back, over

#: Text characters of a chunk; its distinct words and positions are one row.
CHUNK_CHARS = 8 << 20
#: Distinct words of a bucket that a task keeps with their ids; beyond, it starts anew and encodes some again.
WORDS_KEPT = 2_000_000
#: Rows of a batch that goes back to Spark.
ROWS = 256
#: White space as the pre-tokenizer's pattern has it (Unicode White_Space).
_SPACES = " \t-\r\x85\xa0  -     　"
#: Before such a space a piece always ends: a run of white space gives its last space to the word that follows.
_BREAK = re.compile(f" (?=[^{_SPACES}])")
#: Marks a word that no space precedes; lone surrogates are never in a text.
_FIRST = "\ud800"


@cache
def tokenizer(path: str) -> object:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: bytes of each id. Its size is the vocabulary's."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        table[at] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    return table


@cache
def _specials(path: str) -> re.Pattern | None:
    found = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None


def split_words(text: str, specials: re.Pattern | None) -> list[str]:
    """Words whose encodings, one after another, are the text's; a preceding space is left out, its absence marked."""
    if specials is not None and specials.search(text):
        out = []
        for part in specials.split(text):
            words = _BREAK.split(part) if not specials.fullmatch(part) else [part]
            words[0] = _FIRST + words[0]
            out += words
        return out
    words = _BREAK.split(text)
    words[0] = _FIRST + words[0]
    return words


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids of 16 bits, where all fit, after a byte that tells their width."""
    width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=9).compress(ids.astype(f"<u{width}").tobytes())


def _unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype("<u4")


def _split(path: str, buckets: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, task, made = _specials(path), TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        places: list[np.ndarray] = []
        index = _Places()
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, index, size
            groups: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
            for word, at in index.items():
                raw = word[1:].encode() if word[:1] == _FIRST else b" " + word.encode()
                groups[zlib.crc32(raw) % buckets].append((raw, at))
            parts, orders = [], []
            for bucket, slot in enumerate(groups):
                if slot:
                    slot.sort()  # neighbours share their beginnings, which compresses
                    orders.append({"bucket": bucket, "at": _pack(np.array([at for _, at in slot], np.uint32))})
                    parts.append({"bucket": bucket, "sizes": _pack(np.array([len(w) for w, _ in slot], np.uint32)), "words": zstandard.ZstdCompressor(level=9).compress(b"".join([w for w, _ in slot]))})
            row = pa.RecordBatch.from_pylist([{"chunk": (task << 24) | made, "doc_ids": ids.copy(), "lengths": _pack(np.array(lengths, np.uint32)), "places": _pack(np.concatenate(places)), "orders": orders, "parts": parts}], _CHUNK)
            made += 1
            ids.clear(), lengths.clear(), places.clear()
            index, size = _Places(), 0
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = list(map(index.__getitem__, split_words(text, specials)))
                ids.append(doc)
                lengths.append(len(found))
                places.append(np.array(found, np.uint32))
                size += len(text) + 16
                if size >= CHUNK_CHARS:
                    yield chunk()
        if ids:
            yield chunk()

    return run


_ORDER = pa.struct([("bucket", pa.int32()), ("at", pa.binary())])
_PART = pa.struct([("bucket", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("places", pa.binary()), ("orders", pa.list_(_ORDER)), ("parts", pa.list_(_PART))])


def _encode(path: str) -> object:
    """Rows of a bucket follow each other; the table of its distinct words is kept while they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, current = tokenizer(path), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current or len(table) > WORDS_KEPT:
                    table, current = {}, row["bucket"]
                ends = np.cumsum(_unpack(row["sizes"]), dtype=np.int64).tolist()
                raw = zstandard.ZstdDecompressor().decompress(row["words"])
                words = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in words if w not in table]
                for k in range(0, len(new), 4096):
                    some = new[k : k + 4096]
                    for word, got in zip(some, model.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        table[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)
                found = [table[w] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]]), pa.array([row["bucket"]], pa.int32()), pa.array([_pack(np.array([len(x) // 4 for x in found], np.uint32))], pa.binary()), pa.array([_pack_ids(np.frombuffer(b"".join(found), "<u4"))], pa.binary())],
                    names=["chunk", "bucket", "counts", "ids"],
                )

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _assemble(path: str) -> object:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        table = pieces(path)
        orders = {o["bucket"]: _unpack(o["at"]).tolist() for row in docs["orders"].to_pylist() for o in row}
        total = sum(map(len, orders.values()))
        encoded: list[bytes] = [b""] * total
        decoded: list[bytes] = [b""] * total
        for k in range(words.num_rows):
            row = words.slice(k, 1).to_pylist()[0]
            ids, end = _unpack_ids(row["ids"]), 0
            raw, parts = ids.tobytes(), [table[i] for i in ids.tolist()]
            for at, count in zip(orders.pop(row["bucket"]), _unpack(row["counts"]).tolist(), strict=True):
                encoded[at] = raw[4 * end : 4 * (end + count)]
                decoded[at] = b"".join(parts[end : end + count])
                end += count
        out = []
        for row in docs.select(["doc_ids", "lengths", "places"]).to_pylist():
            places, ends = _unpack(row["places"]), np.concatenate([[0], np.cumsum(_unpack(row["lengths"]), dtype=np.int64)])
            for start in range(0, len(row["doc_ids"]), ROWS):
                ids, texts = [], []
                for d in range(start, min(start + ROWS, len(row["doc_ids"]))):
                    here = places[ends[d] : ends[d + 1]].tolist()
                    ids.append(b"".join([encoded[k] for k in here]))
                    texts.append(b"".join([decoded[k] for k in here]).decode("utf-8", "replace"))
                columns = [row["doc_ids"][start : start + ROWS], [len(x) // 4 for x in ids], ids, texts]
                out.append(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _OUT, strict=True)], schema=_OUT))
        del encoded, decoded
        give_back()
        return pa.Table.from_batches(out, _OUT)

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, decoded text) of every row, as the byte-level tokenizer in `tokenizer_path` gives them without adding special tokens.

    1. Texts are split into words where a piece must end; a chunk of about 12 MB keeps its
       distinct words, by bucket of their hash, and each text as positions among them.
    2. Buckets meet: each distinct word of all chunks is encoded once (again only where a bucket
       has more than WORDS_KEPT of them; there are as many buckets as shuffle partitions).
    3. Ids return to their chunk, where positions put them in order; a join of ids and pieces
       decodes each word.
    The file is read on the executors, where `tokenizer_path` must be the same. Special tokens'
    strings within a text become their ids, as the library has it.

    Null and empty texts: no tokens, empty text. Null and repeated ids: rows are returned as
    they come. Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "bpe")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "chunk long, doc_ids array<long>, lengths binary, places binary, orders array<struct<bucket: int, at: binary>>, parts array<struct<bucket: int, sizes: binary, words: binary>>"
    chunks = work.bucketed(over(docs, _split(tokenizer_path, buckets), schema), "chunk", buckets)
    parts = chunks.select("chunk", F.explode("parts").alias("part")).select("chunk", "part.*")
    coded = over(parts.repartition("bucket").sortWithinPartitions("bucket"), _encode(tokenizer_path), "chunk long, bucket int, counts binary, ids binary")
    texts = chunks.select("chunk", "doc_ids", "lengths", "places", "orders")
    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_assemble(tokenizer_path), "doc_id long, n_tokens long, ids binary, decoded string")
