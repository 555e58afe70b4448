"""Numpy helpers that work on many whole texts at once as one byte buffer.

They run inside Arrow tasks.  Texts are UTF-8 bytes, a null text is empty, and
every helper works on blocks of bounded size (``blocks``), so a task's memory
does not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
_U = np.uint64
_ROOT = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INV = pow(_ROOT, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = (np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_blocks(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int = BLOCK_BYTES):
    """(keys, bytes, offsets) of the rows, in blocks of bounded size."""
    for batch in batches:
        buf, off = utf8(batch.column(text))
        ids = batch.column(key)
        for i, j in blocks(off, limit):
            yield ids.slice(i, j - i), buf[off[i]:off[j]], off[i:j + 1] - off[i]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """root**i and root**-i modulo 2**64 for i < n, kept for the next block."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ROOT, _INV)):
            p = np.full(n, base, dtype=_U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] a hash of buf[i:j] times root**i."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * p[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(_U))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run without white space."""
    n = len(buf)
    inside = ~SPACE[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    begin[edge] = inside[edge]
    finish = np.zeros(n + 1, bool)
    finish[1:n] = inside[:-1] & ~inside[1:]
    finish[n] = n > 0 and inside[-1]
    cut = off[1:][off[1:] > 0]
    finish[cut] = inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish)
    return start, end, np.searchsorted(off, start, side="right") - 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for every range, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)


def crc_mod5(key) -> int:
    """crc32 of a key's decimal text modulo 5, as the evaluation splits use it."""
    import zlib

    return zlib.crc32(str(key).encode()) % 5
