"""Words and rolling hashes over Arrow text columns, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, so it never crosses a
document. Hashes are polynomial in an odd multiplier modulo 2**64 over mixed byte values,
then finalised; equal words have equal hashes in every task, process and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BYTE_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_MULTIPLIER))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: 1 an ASCII letter, 2 another ASCII character that isn't white space, 3 the apostrophe, 0 the rest.
_KINDS = np.array([0 if c >= 128 or _SPACE[c] else 1 if chr(c).isalpha() else 3 if c == 39 else 2 for c in range(256)], np.uint8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse**i modulo 2**64 for i < n, kept per process."""
    known = _powers.get(multiplier)
    if known is None or len(known[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        known = _powers[multiplier] = (both[0], both[1])
    return known[0][:n], known[1][:n]


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds, the same wherever the run stands."""
    up, down = powers(multiplier, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a block of documents: byte bounds, hashes, and the words of each document.

    lower: A-Z hash as a-z. cut: words are cut further where an ASCII letter meets another
    ASCII character on either side, but not after an apostrophe.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, cut: bool = False):
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if cut:
            kind = _KINDS[data]
            turn = (kind[:-1] == 1) & (kind[1:] >= 2) | (kind[:-1] == 2) & (kind[1:] == 1)
            first[1:] |= turn
            last[:-1] |= turn
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: The words of document d are those from bounds[d] to bounds[d + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = rolled((_BYTES_LOWER if lower else _BYTES)[data], self.starts, self.ends, _BYTE_MULTIPLIER)

    def windows(self, width: int, which: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each position on; those that leave a document mean nothing."""
        n = max(0, len(self.hashes) - width + 1)
        at = np.arange(n)
        values = self.hashes if which == 0 else mix(self.hashes + np.uint64(which))
        return rolled(values, at, at + width, _WORD_MULTIPLIERS[which])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array without nulls; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes (one longer text is a block): first, end, bytes, offsets."""
    data, offsets = buffers(text_column(column))
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another allocator
    _trim = None


def give_back() -> None:
    """Return what Arrow and numpy have freed to the system: workers live on, and other operators' workers beside them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
