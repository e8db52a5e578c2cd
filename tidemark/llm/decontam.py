"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import over
from tidemark.llm.textkernel import _LANES, NON_ALNUM, mix, text_slices, words

#: Word positions that a seed compares; it ignores the others within its span. Together they hit every window of 15 aligned
#: words with at most 3 substitutions, of 10 to 14 with at most 2, of 8 and 9 with at most 1 (a test tries all of them), and of 5 to 7 with none.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 4, 6, 7))
#: A passage is an aligned window of WINDOW words (or the whole item, if shorter) of which at least 80 % agree.
WINDOW = 15
#: Items of fewer words must agree in all of them; with fewer than a seed compares, a text must be the item and nothing else.
EXACT_WORDS = 8
SEED_WORDS = len(MASKS[0])
#: Words of benchmark items that are broadcast at once, one item at least; more are taken in further passes over the documents.
PASS_WORDS = 1_000_000
#: Seed hits that are expanded at once, and words of aligned items that are compared at once.
HITS, COMPARED = 1 << 18, 1 << 16

_PAIR = np.uint64(0xD6E8FEB86659FD93)
_NONE_HERE, _NONE_THERE = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x7C01812CF721AD1C)


def needed(length: int) -> int:
    """Words that must agree in the window of an item of `length` words."""
    return length if length < EXACT_WORDS else -(-4 * min(length, WINDOW) // 5)


def _seeds(hashes: np.ndarray, mask: tuple[int, ...], lane: int) -> np.ndarray:
    span = mask[-1] + 1
    if len(hashes) < span:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - span + 1, lane, np.uint64)
    for k, at in enumerate(mask):
        out += hashes[at : len(hashes) - span + 1 + at] * _LANES[k]
    return mix(out)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of the runs that begin at `starts`, one run after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _whole(hashes: np.ndarray) -> int:
    return int(np.append(hashes * _LANES[: len(hashes)], _LANES[32 + len(hashes)]).sum(dtype=np.uint64))


class Index:
    """The seeds of benchmark items: bounded by PASS_WORDS.

    Places of one seed are ordered by the seed before them in their item, so that the places
    where an alignment merely goes on are one range, which a lookup leaves out.
    """

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.items, held, self.short = [], [], {}
        values, before, owners, places = [], [], [], []
        for item, text in rows:
            _, data, offsets = next(text_slices(pa.array([text or ""]), 1 << 62))
            hashes, _, _ = words(data, offsets, NON_ALNUM, True)
            if not len(hashes):
                continue
            at = len(self.items)
            self.items.append(item)
            held.append(hashes)
            if len(hashes) < SEED_WORDS:
                self.short.setdefault(_whole(hashes), []).append(at)
            for lane, mask in enumerate(MASKS):
                found = _seeds(hashes, mask, lane)
                values.append(found)
                before.append(np.concatenate([[_NONE_THERE], found[:-1]])[: len(found)])
                owners.append(np.full(len(found), at, np.int32))
                places.append(np.arange(len(found), dtype=np.int32))
        self.lengths = np.array([len(h) for h in held], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.words = np.concatenate([*held, np.zeros(0, np.uint64)])
        value = np.concatenate([*values, np.zeros(0, np.uint64)])
        self.values, rank = np.unique(value, return_inverse=True)
        self.rank_bits = max(1, int(len(self.values)).bit_length())
        key = self._key(rank.astype(np.uint64), np.concatenate([*before, np.zeros(0, np.uint64)]))
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(self.values)))]).astype(np.int64)
        self.owners, self.places = (np.concatenate([*x, np.zeros(0, np.int32)])[order].astype(np.int32) for x in (owners, places))
        self.bits = max(16, int(np.ceil(np.log2(len(self.values) + 1))) + 4)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.values >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _key(self, rank: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (rank << np.uint64(64 - self.rank_bits)) | (mix(before * _PAIR) >> np.uint64(self.rank_bits))

    def hits(self, hashes: np.ndarray, row_of: np.ndarray, decided: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """(item, place of the item's first word among `hashes`) where an alignment's seed hits begin, in blocks without repeats; places in decided rows are passed over."""
        kept, size = [], 0
        longest = int(self.lengths.max(initial=0))
        width = longest + len(hashes)

        def distinct() -> np.ndarray:
            item, start = np.divmod(np.unique(np.concatenate(kept)), width)
            return np.stack([item, start - longest], axis=1)

        for lane, mask in enumerate(MASKS):
            seeds = _seeds(hashes, mask, lane)
            at = np.flatnonzero(self.maybe[(seeds >> np.uint64(64 - self.bits)).astype(np.int64)])
            rank = np.searchsorted(self.values, seeds[at])
            here = self.values[np.minimum(rank, max(len(self.values) - 1, 0))] == seeds[at] if len(self.values) else np.zeros(0, bool)
            at, rank = at[here], rank[here]
            # Each row begins anew, as the rows before it may be passed over.
            goes_on = (at > 0) & (row_of[at] == row_of[np.maximum(at, 1) - 1])
            key = self._key(rank.astype(np.uint64), np.where(goes_on, seeds[np.maximum(at, 1) - 1], _NONE_HERE))
            lo, hi = self.starts[rank], self.starts[rank + 1]
            skip, back = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            counts = (skip - lo) + (hi - back)
            ends = np.cumsum(counts)
            k = 0
            while k < len(at):
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HITS, "right")))
                part = np.arange(k, stop)
                part = part[counts[part] > 0]
                if decided is not None:
                    part = part[~decided[row_of[at[part]]]]
                k = stop
                if not len(part):
                    continue
                which = np.concatenate([_spans(lo[part], skip[part] - lo[part]), _spans(back[part], hi[part] - back[part])])
                where = np.concatenate([np.repeat(at[part], skip[part] - lo[part]), np.repeat(at[part], hi[part] - back[part])])
                kept.append(self.owners[which] * np.int64(width) + (where - self.places[which] + longest))
                size += len(which)
                if size >= HITS:
                    yield distinct()
                    kept, size = [], 0
        if kept:
            yield distinct()


def _best(found: np.ndarray) -> np.ndarray:
    """Of (row, item, words that agree, first word, last word) the largest of each row and item."""
    found = found[np.lexsort(found.T[::-1])]
    last = np.ones(len(found), bool)
    last[:-1] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[last]


def _verified(index: Index, hashes: np.ndarray, row_of: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """(row, item, words that agree, first word, last word) of the alignments' passages: from the first good window within a row to its last."""
    item, start = aligned[:, 0], aligned[:, 1]
    a, b = np.maximum(start, 0), np.minimum(start + index.lengths[item], len(hashes))
    counts = b - a
    place = _spans(a, counts)
    agree = hashes[place] == index.words[_spans(index.base[item] + a - start, counts)]
    sums = np.zeros(len(place) + 1, np.int32)
    np.cumsum(agree, out=sums[1:])
    # Windows that start at a word, and those that do so within their alignment.
    window = np.minimum(index.lengths[item], WINDOW)
    inside = np.maximum(counts - window + 1, 0)
    ends = np.cumsum(counts)
    at, owner = _spans(ends - counts, inside), np.repeat(np.arange(len(aligned)), inside)
    least = np.where(index.lengths[item] < EXACT_WORDS, index.lengths[item], -(-4 * window // 5))
    good = sums[at + np.repeat(window, inside)] - sums[at] >= np.repeat(least, inside)
    at, owner = at[good], owner[good]
    good = row_of[place[at]] == row_of[place[at] + window[owner] - 1]
    at, owner = at[good], owner[good]
    if not len(at):
        return np.zeros((0, 5), np.int64)
    row = row_of[place[at]]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])])
    end = np.concatenate([new[1:], [True]])
    first, last, mine = at[new], at[end] + window[owner[end]] - 1, owner[new]
    return np.stack([row[new], item[mine], sums[last + 1] - sums[first], place[first], place[last]], axis=1)


def passages(index: Index, hashes: np.ndarray, first: np.ndarray, rows_only: bool = False) -> np.ndarray:
    """(row, item, words that agree, first word, last word) of the best verified alignment of each row and item, in order; with `rows_only` at least one for each row that has any."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    decided = np.zeros(len(first) - 1, bool) if rows_only else None
    out = [np.zeros((0, 5), np.int64)]
    for row in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SEED_WORDS)).tolist() if index.short else []:
        lo, hi = int(first[row]), int(first[row + 1])
        out += [np.array([[row, item, hi - lo, lo, hi - 1]]) for item in index.short.get(_whole(hashes[lo:hi]), [])]
    for aligned in index.hits(hashes, row_of, decided):
        size = np.cumsum(index.lengths[aligned[:, 0]])
        k = 0
        while k < len(aligned):
            stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + COMPARED, "right")))
            some, k = aligned[k:stop], stop
            if decided is not None:
                edge = len(row_of) - 1
                a, b = np.clip(some[:, 1], 0, edge), np.clip(some[:, 1] + index.lengths[some[:, 0]] - 1, 0, edge)
                some = some[~(decided[row_of[a]] & (row_of[a] == row_of[b]))]
            found = _verified(index, hashes, row_of, some) if len(some) else out[0]
            if decided is not None:
                decided[found[:, 0]] = True
            out.append(_best(found))
    return _best(np.concatenate(out))


def _find(index: Broadcast) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                hashes, first, starts = words(data, offsets, NON_ALNUM, True)
                docs = batch.column(0)
                found = [
                    {"doc_id": docs[row + r].as_py(), "item_id": held.items[item], "n_agree": agree, "n_words": hi - lo + 1, "item_words": int(held.lengths[item]), "first_byte": int(starts[lo] - offsets[r]), "last_word_byte": int(starts[hi] - offsets[r])}
                    for r, item, agree, lo, hi in passages(held, hashes, first).tolist()
                ]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _FOUND)

    return run


_FOUND = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_agree", "n_words", "item_words", "first_byte", "last_word_byte")])


def _drop(index: Broadcast, at: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            clean = np.ones(len(batch), bool)
            for row, data, offsets in text_slices(batch.column(at)):
                hashes, first, _ = words(data, offsets, NON_ALNUM, True)
                clean[row + passages(held, hashes, first, True)[:, 0]] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """One broadcast index of at most about PASS_WORDS words for each pass; the passes' number follows the benchmark's size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_WORDS))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        yield spark.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: doc_id, item_id, n_agree of n_words aligned words, item_words, and the bytes where the passage's first and last word start.

    Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; kana and Han
    characters are words of their own. Seeds of the benchmark's words are joined with those of
    the documents' within each task, and around each hit the item is laid over the document: a
    passage counts if in some window of 15 words (or the whole item) at least 80 % agree. An
    item of 5 to 7 words must be there word for word, and a text must be the same words as an
    item of fewer, since such items turn up anywhere. Hits that only continue an alignment are
    not expanded, so a repetitive text costs as many checks as it has alignments, in blocks of
    bounded size. The documents are not shuffled.

    Null and empty texts hold nothing, and items without words are in nothing.
    Null ids stay null; repeated rows give repeated rows. Empty tables: no rows. Other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} long" for f in _FOUND)
    out = None
    for index in _indexes(benchmark):
        found = over(rows, _find(index), schema)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a passage of the benchmark (see contaminations); all columns stay. No shuffle."""
    for index in _indexes(benchmark):
        docs = over(docs, _drop(index, docs.columns.index(text_col)), docs.schema)
    return docs
