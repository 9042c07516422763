"""Words, shingles and 64-bit hashes of many texts at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SEGMENT)
_INV = _powers(pow(_BASE, -1, 2**64), _SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data, which has no word cut at its ends."""
    flags = np.empty(len(data) + 2, bool)
    flags[0] = flags[-1] = True
    flags[1:-1] = _SPACE[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(data)
    if n <= _SEGMENT:
        power, inverse = _POW, _INV
    else:
        power, inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))


def words_of(text: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) and hashes of a text's words, a segment at a time."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _SEGMENT:
        return _segment_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data):  # up to the next space, that no word is cut
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(data))
        starts, ends, hashes = _segment_words(data[at:end])
        parts.append((starts + at, ends + at, hashes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words, in order; the whole sequence is one run if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out = (out ^ (hashes[j : n - size + 1 + j])) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(size))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. Sorting is faster here than the hash table of np.unique."""
    out = np.sort(hashes)
    if len(out) < 2:
        return out
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def batches_of_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of the column: its index, word starts, ends and hashes.

    Short texts are joined by a space and hashed together, as numpy has a cost for each call.
    """
    group: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(column):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if len(raw) > _SEGMENT // 4:
            yield i, *words_of(raw)
            continue
        if size + len(raw) + 1 > _SEGMENT and group:
            yield from _joined(group)
            group, size = [], 0
        group.append((i, raw))
        size += len(raw) + 1
    if group:
        yield from _joined(group)


def _joined(group: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    data = np.frombuffer(b" ".join(x for _, x in group), np.uint8)
    starts, ends, hashes = _segment_words(data)
    sizes = np.array([len(x) + 1 for _, x in group])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.searchsorted(starts, offsets)
    for n, (i, _) in enumerate(group):
        a, b = cuts[n], cuts[n + 1]
        yield i, starts[a:b] - offsets[n], ends[a:b] - offsets[n], hashes[a:b]


def binary(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
