"""Words, shingles and mixing of 64-bit hashes over whole texts, in numpy.

A word is a maximal run of bytes other than ASCII white space (x20, x09-x0D). Word hashes are
differences of one prefix sum over the text's bytes, so a text is hashed in a few array passes
whatever its length; texts beyond CHUNK bytes are cut at white space, which changes no word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Inverse of _BASE modulo 2**64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, 2 * len(_powers[k])), base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finisher)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of_chunk(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words of a UTF-8 text, A-Z taken as a-z."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= CHUNK:
        return _words_of_chunk(b)
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + CHUNK)
        while end < len(b) and not _SPACE[b[end]]:
            end += 1
        s, e, h = _words_of_chunk(b[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; with fewer words, one hash of the whole sequence; none without words."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _STEP + h[j : n - width + 1 + j]
    return mix(out)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values, by doubling."""
    done, out = 1, v
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = np.minimum(out[: len(out) - (width - done)], out[width - done :])
    return out


def char_offsets(data: bytes) -> np.ndarray | None:
    """For each byte offset (0 to len), the code points before it; None where bytes are code points."""
    if data.isascii():
        return None
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=out[1:])
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and after a task's last batch the memory that the worker holds on to is handed back; workers serve many tasks."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return all_of
