"""Words, shingles and rolling hashes of many texts at once, on numpy arrays of bytes.

Used inside Arrow tasks: Spark splits the rows, these functions see one batch. All work on
the UTF-8 bytes of a batch laid end to end, in segments of bounded size, so memory follows
the batch and not the longest text. A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SEGMENT = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Random numbers per byte, the same in every task.
_BYTES = np.random.RandomState(1).randint(0, 1 << 62, (2, 256)).astype(_U)
_BYTES = (_BYTES[0] << _U(2)) ^ _BYTES[1] | _U(1)
GEAR = (_BYTES >> _U(40)).astype(np.uint16)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if not _powers or next(iter(_powers)) < n:
        size = max(n, SEGMENT + 1)
        pair = []
        for base in (_BASE, _INVERSE):
            values = np.full(size, base, _U)
            values[0] = 1
            pair.append(np.multiply.accumulate(values))
        _powers.clear()
        _powers[size] = (pair[0], pair[1])
    return next(iter(_powers.values()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts end to end, and where each starts (one more entry than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def row_groups(at: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _segments(data: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``SEGMENT`` bytes that cut no word (longer only for a longer word)."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + SEGMENT, n)
        if b < n:
            free = np.flatnonzero(SPACE[data[a:b]] | edge[a + 1 : b + 1])
            if len(free):
                b = a + int(free[-1]) + 1
            else:
                rest = np.flatnonzero(SPACE[data[b:]] | edge[b + 1 :][: n - b])
                b = b + int(rest[0]) + 1 if len(rest) else n
        yield a, b
        a = b


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the number of the first word of each text.

    The last array has one more entry than there are texts.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends, hashes = [], [], []
    for a, b in _segments(data, edge):
        part = data[a:b]
        solid = ~SPACE[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[a + 1 : b]
        last[:-1] &= ~solid[1:] | edge[a + 1 : b]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _tables(len(part))
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTES[part] * power[: len(part)], out=total[1:])
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mixed((total[e] - total[s]) * inverse[s]))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(at), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, at)


def sequences(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each run of words ``low`` to ``high`` (exclusive)."""
    power, inverse = _tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mixed((total[high] - total[low]) * inverse[low] + (high - low).astype(_U))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the number of the first one of each text.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    count = np.diff(first)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    text = np.repeat(np.arange(len(count)), each)
    low = first[text] + (np.arange(bounds[-1]) - bounds[text])
    return sequences(hashes, low, np.minimum(low + size, first[text + 1])), bounds


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[byte] modulo 2^16 after each byte: of the last 16 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        later = h[step:] + (h[:-step] << np.uint16(step))
        h[step:] = later
    return h
