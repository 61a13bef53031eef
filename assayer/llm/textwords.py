"""Hashes of the words of whole Arrow batches of texts, by numpy over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; both are ASCII, so characters stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    name = "inverse" if inverse else "power"
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, PIECE), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name]


def _hashed(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a piece; a word also ends before each offset in breaks."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    word = ~space
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(n, False)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(n, True)[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts laid end to end in data, and the words before each of offsets (the texts' bounds)."""
    found, starts, at, n = [], [], int(offsets[0]), int(offsets[-1])
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # back to the last break between words, or on to the next one
            tail = np.flatnonzero(_SPACE[data[at:to]])
            inner = offsets[np.searchsorted(offsets, to, "right") - 1]
            back = max(int(inner), at + int(tail[-1]) if len(tail) else 0)
            while back <= at and to < n:
                more = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                bound = int(offsets[np.searchsorted(offsets, to, "left")])
                back = min(bound, to + int(more[0]) if len(more) else to + PIECE if to + PIECE < n else n)
                if len(more) or back == bound:
                    break
                to, back = back, at
            to = back if back > at else n
        inside = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "right")] - at
        h, s, _ = _hashed(data[at:to], inside)
        found.append(h)
        starts.append(s + at)
        at = to
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, word bounds of the rows): rows of about `most` bytes together; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, bounds, body = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        own = offsets[first : last + 1]
        yield (first, last, *hash_words(data[: own[-1]], own))
        first = last


_ORDER = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(h: np.ndarray, size: int, kept: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of `size` words, over the positions in kept (all)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size) if kept is None else kept:
        total += h[k : k + n] * _ORDER[k % 64]
    return mix(total)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct runs of `size` words of a text; one run of all its words if they are fewer; none without words."""
    return np.unique(windows(h, size if len(h) >= size else len(h))) if len(h) else np.zeros(0, np.uint64)
