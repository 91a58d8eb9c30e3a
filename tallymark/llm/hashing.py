"""Vectorised word and shingle hashes of whole texts, one Arrow batch at a time.

Words are runs of bytes other than ASCII white space (``\\x09-\\x0d``, space)
after lower-casing A-Z, so no Unicode rule is involved. Every hash is a pure
function of the bytes: the same on every executor and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _LOWERED = ~_SPACE, _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_UP = _DOWN = np.ones(0, np.uint64)
#: Room for two columns of numbers a byte, kept between calls: fresh memory costs more than the arithmetic.
_ROOM = np.empty((2, 0), np.uint64)


def _tables(n: int):
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 1 << 16)
        _UP, _DOWN = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _UP, _DOWN


def _scratch(n: int) -> np.ndarray:
    global _ROOM
    if n > 1 << 20:  # a very long text's is not kept
        return np.empty((2, n), np.uint64)
    if _ROOM.shape[1] < n:
        _ROOM = np.empty((2, max(n, 1 << 16)), np.uint64)
    return _ROOM[:, :n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of the words of one run of UTF-8 bytes, in order."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate(([] if space[0] else [0], edge, [] if space[-1] else [len(data)])).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return none.astype(np.uint64), none, none
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the exact bytes of spans of one run of bytes."""
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one run of UTF-8 bytes, in order."""
    return word_spans(data)[0]


def run_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of adjoining texts in one step, as ``word_hashes`` gives them text by text, and the words of each."""
    low = int(offsets[0])
    data, bounds = data[low:int(offsets[-1])], offsets - low
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    inside, cut = _WORD.take(data), np.zeros(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=cut[1:-1])
    cut[bounds] = True
    start, end = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
    up, down = _tables(len(data) + 1)
    hashed, total = _scratch(len(data) + 1)
    np.take(_LOWERED, data, out=hashed[1:], mode="clip")
    hashed[1:] *= up[:len(data)]
    hashed[0] = 0
    np.cumsum(hashed, out=total)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), np.diff(np.searchsorted(start, bounds))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without its nulls' bytes, and the offsets of every row."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data, offsets


def words_of(column: pa.Array) -> list[np.ndarray]:
    """Word hashes of every row."""
    data, offsets = texts_of(column)
    return [word_hashes(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words.

    Fewer words count as one run; without words there is none.
    """
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    out = np.full(n, size if len(words) >= size else len(words), np.uint64)
    for i in range(min(size, len(words))):
        out = mix(out * np.uint64(_BASE) + words[i:i + n])
    return np.unique(out)


def set_hash(values: np.ndarray, salt: int) -> int:
    """Hash of a set of hashes, as a signed 64-bit number."""
    total = mix(values + np.uint64(salt)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(values))).astype(np.int64)[0])
