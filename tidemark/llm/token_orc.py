"""Token ids in ORC: range-sorted stripes with run-length-encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import tokenizer
from tidemark.llm.shared import over
from tidemark.llm.textkernel import LOWER, SPACE, text_slices

#: Distinct units that a worker keeps with their ids before it starts anew.
WORDS_KEPT = 900_000
#: ORC: integers of lists and counts are run-length encoded by the format itself.
OPTIONS = {
    "orc.compress": "ZSTD", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
#: Text bytes that are encoded at once, or one text, if that is longer; and those of them that are cut into units at once.
SLICE_BYTES, RUN_BYTES = 8 << 20, 1 << 20
#: Longer units are encoded each time: no cache holds texts without spaces.
UNIT_BYTES = 128
#: Rows of a batch that goes back to Spark.
ROWS = 512

#: White space of ASCII, letters, digits, other printable ASCII; all else is left to the library.
_GAP, _LETTER, _DIGIT, _OTHER, _LEFT = range(5)
_KIND = np.full(256, _LEFT, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[SPACE] = _GAP
_SPACES = re.compile(rb"[ \t-\r]")
#: Words of printable ASCII and Latin letters: these alone are normalised, split and mapped to bytes here, and only the merges left to the library's model.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _contractions(low: np.ndarray, head: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 's 't 're 've 'm 'll 'd start and the byte after each: an apostrophe that other signs precede belongs to them."""
    at = np.flatnonzero((low == ord("'")) & cut)
    one = np.append(low, [0, 0])[at + 1]
    two = np.append(low, [0, 0])[at + 2]
    inside = ~np.append(head, [True, True])
    letter = inside[at + 1] & np.isin(one, list(b"stmd"))
    pair = inside[at + 1] & inside[at + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    return at[letter | pair], (at + 2 + pair)[letter | pair]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(units of the rows' UTF-8 bytes, index of the first of each row, with one entry more than rows).

    The ids of a row's units, one after another, are the row's. Words between white space of
    ASCII are units as they are, but those of printable ASCII and Latin letters, where no
    special token can be, are lower-cased and cut as the tokenizer's pattern does it.
    """
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[offsets < len(data)]
    first[inner] = solid[inner]
    row_at = np.where(offsets > 0, np.cumsum(solid, dtype=np.int32)[offsets - 1], 0)
    # From here on without white space: bytes of words, and which of them start one.
    raw, head = data[solid], first[solid]
    kind, low = _KIND[raw], LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    latin = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[latin], after[latin]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = np.where(after < 0x9F, after + 0x20, after)

    odd = kind == _LEFT
    odd[1:] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|")) & ~head[1:]
    starts = np.flatnonzero(head)
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
    left = np.repeat(whole, np.diff(starts, append=len(raw)))

    cut = head | (kind == _DIGIT)
    cut[1:] |= kind[1:] != kind[:-1]
    at, end = _contractions(low, head, cut)
    cut[at + 1] = False
    cut[end[end < len(raw)]] = True
    cut = np.where(left, head, cut)
    begin = np.flatnonzero(cut)
    made = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(np.where(left, raw, low))])
    return made, np.searchsorted(begin, row_at)


class _Kept(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make: object) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(key) <= UNIT_BYTES:
            self[key] = value
        return value


class WordEncoder:
    """Ids of texts by their units: the tokenizer drops white space and no token spans it."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.kept = _Kept(self._unit)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.chars = "".join([chars[b] for b in range(256)])

    def _unit(self, raw: bytes) -> bytes:
        unit = raw.decode()
        if _PLAIN.fullmatch(unit) and "<|" not in unit:
            ids = [t.id for t in self.model.tokenize(codecs.charmap_decode(raw, "strict", self.chars)[0])]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each) of rows of UTF-8 bytes."""
        cuts = [0]
        while found := _SPACES.search(data, cuts[-1] + RUN_BYTES):
            cuts.append(found.end())
        runs, first = [], np.zeros(len(offsets), np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
            found, at = units(data[a:b], np.clip(offsets, a, b) - a)
            runs.append(found.dictionary_encode())
            first += at
        runs = pa.chunked_array(runs).unify_dictionaries().chunks
        blobs = list(map(self.kept.__getitem__, runs[0].dictionary.to_numpy(zero_copy_only=False).tolist()))
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        held = np.frombuffer(b"".join(blobs), "<i4")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        place = np.concatenate([r.indices.to_numpy() for r in runs])
        counts = size[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = held[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[place] - ends[:-1], counts)]
        return ids, np.diff(ends[first])

    def text(self, text: str) -> bytes:
        """Ids of one text as little-endian 32-bit integers."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.rows(data, np.array([0, len(data)]))[0].tobytes()


_encoders: dict[str, WordEncoder] = {}


def _encode(path: str, end_id: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path)), 0
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                ids, counts = encoder.rows(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                for k in range(0, len(counts), ROWS):
                    at = ends[k : k + ROWS + 1]
                    lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row + k, len(at) - 1), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], names=["doc_id", "start_in_file", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row's ids, `end_id` after them, to ORC files that follow each other in ascending doc_id order.

    Rows: doc_id, start_in_file (ids before the document's in its file), n_tokens, ids. One
    shuffle by ranges of doc_id; file names follow the ranges, so a reader prunes files,
    stripes and row groups by their statistics and Bloom filters, and reads stripes in parallel.
    Null ids come first; rows of one id follow each other by text. Null and empty texts have
    `end_id` alone. An empty table makes a folder without rows. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = over(ranged, _encode(tokenizer_path, end_id), "doc_id long, start_in_file long, n_tokens long, ids array<int>")
    coded.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote, each row with its file. Filters on doc_id are pushed to the files' metadata."""
    schema = "doc_id long, start_in_file long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(path).withColumn("file", F.col("_metadata.file_name"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        ends = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8))
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all rows before, over files in the order of their part numbers."""
    totals = tokens.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    # Part numbers have five digits or more: names don't sort as they do. One row a file.
    part = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long")
    before = totals.select("file", (F.sum("held").over(W.orderBy(part, "file")) - F.col("held")).alias("base"))
    rows = tokens.select("file", "doc_id", "start_in_file", "n_tokens", "ids")
    sums = over(rows, _checksums, "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    return sums.join(before, "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
