"""Vectorised word and shingle hashing over Arrow string batches.

Everything works on the raw UTF-8 bytes of a bounded slice of a batch, so memory
follows SLICE_BYTES (or one text, if that is longer) and never the batch size.
Hashes depend on the bytes of a word only: the same word has the same 64-bit hash
in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are expanded to arrays at once.
SLICE_BYTES = 512 << 10

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_LANES = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the near-duplicate contract: space and the controls 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of the looser word notion: all ASCII but letters and digits.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INV, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about `limit` bytes of text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _characters(data: np.ndarray) -> np.ndarray:
    """Where kana and Han characters of three bytes start (U+3040-30FF, U+4000-9FFF)."""
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    after = data[np.minimum(lead + 1, len(data) - 1)]
    return lead[(data[lead] > 0xE3) | ((after >= 0x81) & (after <= 0x83))]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, characters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lower-cased, index of the first word of each row, byte where each word starts).

    Rows end words. The second array has one entry more than rows. With `characters`, kana and
    Han characters, which are written without spaces, are words of their own.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    letter = ~separators[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    if characters and len(wide := _characters(data)):
        cut = np.unique(np.concatenate([cut, wide, wide + 3]))
        cut = cut[(cut > 0) & (cut < n)]
    before[cut] = False
    start = np.flatnonzero(letter & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, letter[1:]
    after[cut - 1] = False
    end = np.flatnonzero(letter & ~after)
    sums = np.cumsum(_BYTE[LOWER[data]] * _power("up", n))
    value = sums[end]
    inner = start > 0
    value[inner] -= sums[start[inner] - 1]
    value *= _power("down", n)[start]
    return mix(value), np.searchsorted(start, offsets), start


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row and the index of each row's first; a row of fewer words has its whole sequence as one, a row without words none."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(made, out=at[1:])
    total = len(hashes)
    out = np.empty(at[-1], np.uint64)
    if total >= size:
        run = np.zeros(total - size + 1, np.uint64)
        for k in range(size):
            run += hashes[k : total - size + 1 + k] * _LANES[k]
        row = np.repeat(np.arange(len(counts)), made)
        place = np.arange(at[-1]) - at[row] + first[row]
        long = counts[row] >= size
        out[long] = run[place[long]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        w = hashes[first[r] : first[r + 1]]
        out[at[r]] = np.append(w * _LANES[: len(w)], _LANES[32 + len(w)]).sum(dtype=np.uint64)
    return mix(out), at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats, and the new row starts."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]
