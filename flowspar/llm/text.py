"""Vectorised text kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of whole documents with numpy and never loop over words in Python.
A *word* is a maximal run of word bytes; which bytes count is set by a 256-entry table (``WORD`` takes ASCII
letters, digits and every non-ASCII byte; ``GRAPHIC`` takes everything but ASCII white space).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1B54A32D192ED03
_INV = pow(_BASE, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
GRAPHIC = np.ones(256, bool)
GRAPHIC[[9, 10, 11, 12, 13, 32, 28, 29, 30, 31]] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown on demand, kept per process)."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        p = np.full(size, np.uint64(_BASE))
        q = np.full(size, np.uint64(_INV))
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > 1 << 22:  # a single huge document: not worth keeping
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def strings(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, n + 1) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if lower:
        column = pc.utf8_lower(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: (first row, end row, bytes, offsets). A longer row comes alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin (n + 1). Words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: see ``spans``."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * MULT)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each row's words begin."""
    starts, ends, rows = words(data, offsets, table)
    return spans(prefix(data), starts, ends), rows


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 values; row borders are the caller's business)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : len(hashes) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def gram_rows(rows: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that stay inside a row, and where each row's begin."""
    count = np.maximum(np.diff(rows) - (n - 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(rows[:-1], count)
    return at, begin


def by_row(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; begin has n + 1 entries."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[begin[1:]] - sums[begin[:-1]]
