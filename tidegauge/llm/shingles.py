"""Vectorised words and word shingles of whole texts, as 64-bit hashes.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``), with A-Z lower-cased.  A text's shingles are its
distinct runs of five words; a text of one to four words has its whole sequence
as the only shingle, and a text without words has none.

A whole Arrow batch is hashed at once: with random 64-bit values ``T`` per byte
and an odd base ``B``, the prefix sums of ``T[byte] * B**position`` modulo 2**64
give every word's hash by one subtraction and one multiplication, then a mixer
spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WIDTH = 5
#: Bytes of text that are hashed together; longer texts are hashed alone.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_TABLE[65:91] = _TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [U64(int(x) | 1) for x in _rng.integers(1, 2**63, WIDTH + 1, dtype=np.int64)]
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, U64(base))
            steps[0] = U64(1)
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about SLICE_BYTES; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]  # words end where texts do
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def row_shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return np.zeros(0, U64)
    if len(words) < WIDTH:
        total = U64(len(words)) * _MIX[WIDTH]
        for k, w in enumerate(words):
            total = total + w * _MIX[k]
        return mix(np.array([total], U64))
    total = words[: len(words) - WIDTH + 1] * _MIX[0]
    for k in range(1, WIDTH):
        total = total + words[k : len(words) - WIDTH + 1 + k] * _MIX[k]
    return np.unique(mix(total))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each row, in order."""
    with np.errstate(over="ignore"):
        for _, data, offsets in slices(column):
            starts, ends, rows = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            for a, b in zip(rows[:-1], rows[1:]):
                yield row_shingles(hashes[a:b])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from NumPy rows."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), kind))
