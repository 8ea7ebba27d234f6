"""Periodic runs of words, by Lyndon words, and their collapse.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; `Params` keeps
those of at least max(`min_words`, `min_periods` * q) words. By the runs theorem every run of two periods and more
starts, within its first period, with a Lyndon word of length q that is the longest one at its place under the order of
words or under the reversed one. So for both orders a stack is scanned right to left: it gives each place
the next smaller suffix, hence its longest Lyndon word. Suffixes are compared, and runs extended to both sides, by the
longest common extension: a few words directly, then a gallop and a binary search over rolling hashes modulo
2**61 - 1. A place is opened only where sampled words repeat, and every run found is verified word by word, its
maximality too. No suffix array; memory is linear in the words of one text.

Words are maximal runs other than x20, x09-x0D, compared by their bytes. Null text has no words; a table without rows
gives none; repeated rows give a row each; extra columns are ignored. A null doc_id is never planted with.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans.storage import small_batches

_PRIME = (1 << 61) - 1
_BASE = 0x1234567DEADBEEF % _PRIME
#: Words compared directly before hashes are asked.
_DIRECT = 8

_powers = [1]


@dataclass(frozen=True)
class Params:
    min_words: int = 24
    min_periods: int = 3


class Words:
    """A sequence of word numbers with its longest common extensions."""

    def __init__(self, ranks: list[int]):
        self.w, self.n = ranks, len(ranks)
        self._sums: list[int] | None = None
        self._near: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> list[int]:
        if self._sums is None:
            while len(_powers) <= self.n:
                _powers.append(_powers[-1] * _BASE % _PRIME)
            h, out = 0, [0]
            for x in self.w:
                h = (h * _BASE + x + 1) % _PRIME
                out.append(h)
            self._sums = out
        return self._sums

    def forward(self, i: int, j: int) -> int:
        """The number of equal words from i and from j on; i < j. The last answer for a distance is reused next to its place."""
        w, most = self.w, self.n - j
        known, length = self._near.get(j - i, (-1, 0))
        k = 0
        while k < most and w[i + k] == w[j + k]:
            k += 1
            if i + k == known:
                k += length
                break
            if k == _DIRECT:
                k = self._search(k, most, lambda m, s: (s[i + m] - s[i] * _powers[m] - s[j + m] + s[j] * _powers[m]) % _PRIME == 0)
                break
        self._near[j - i] = (i, k)
        return k

    def backward(self, i: int, j: int) -> int:
        """The number of equal words that end before i and before j; i < j."""
        w, k = self.w, 0
        while k < i and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
            if k == _DIRECT:
                return self._search(k, i, lambda m, s: (s[i] - s[i - m] * _powers[m] - s[j] + s[j - m] * _powers[m]) % _PRIME == 0)
        return k

    def _search(self, low: int, most: int, equal) -> int:
        """The largest length up to `most` at which the hashes are equal; equal at low."""
        sums, high = self._hashes(), 2 * low
        while high <= most and equal(high, sums):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if equal(mid, sums):
                low = mid
            else:
                high = mid
        return low

    def next_smaller(self, sign: int) -> np.ndarray:
        """For each place the next place whose suffix is smaller (n: none), by a stack from right to left.

        sign -1 reverses the order of words; a suffix that ends first is the smaller one in both orders.
        """
        n, w = self.n, self.w if sign > 0 else [-x for x in self.w]
        out, stack = [n] * n, []
        for i in range(n - 1, -1, -1):
            x = w[i]
            while stack:
                j = stack[-1]
                y = w[j]
                if y < x:
                    break
                if y == x:
                    k = self.forward(i, j)
                    if j + k == n or w[j + k] < w[i + k]:
                        break
                stack.pop()
            if stack:
                out[i] = stack[-1]
            stack.append(i)
        return np.array(out, np.int64)


def find_runs(ranks: np.ndarray, params: Params = Params()) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the sequence, by start, then period."""
    n = len(ranks)
    if params.min_periods < 3:
        raise ValueError("the first root of a run is sure to be followed by another from three periods on")
    if n < max(params.min_words, params.min_periods):
        return []
    words = Words(ranks.tolist())
    found: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        after = words.next_smaller(sign)
        at = np.arange(n)
        period = after - at
        # a run of three periods holds two whole roots from its first root on
        at = at[at + 2 * period <= n]
        period = period[at]
        for part in (lambda q: 0, lambda q: q - 1, lambda q: q // 2):
            keep = ranks[at + part(period)] == ranks[at + period + part(period)]
            at, period = at[keep], period[keep]
        reached: dict[int, int] = {}  # period -> end of the last stretch seen
        for b, q in zip(at.tolist(), period.tolist(), strict=True):
            if b + 2 * q <= reached.get(q, -1):
                continue
            right = words.forward(b, b + q)
            if right < q:
                continue
            start, stop = b - words.backward(b, b + q), b + q + right
            reached[q] = stop
            if stop - start >= max(params.min_words, params.min_periods * q):
                found.add((start, stop - start, q))
    for start, length, q in found:
        stop = start + length
        whole = np.array_equal(ranks[start : stop - q], ranks[start + q : stop])
        if not whole or (start and ranks[start - 1] == ranks[start - 1 + q]) or (stop < n and ranks[stop] == ranks[stop - q]):
            raise ArithmeticError("two different stretches of words have one hash")
    return sorted((s, length, q) for s, length, q in found)


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words only."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repetition put in where crc32 of the decimal id is divisible by ten."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    keep = np.cumsum(depth)[:-1] == 0
    return [words[i] for i in np.flatnonzero(keep)]


def _best(runs: list[tuple[int, int, int]]) -> tuple:
    """start, length, period and thousandths of the exponent of the run with the most periods, exactly compared."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def periodic_runs(docs: DataFrame, params: Params = Params(), plant: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period) and collapsed (the text without the repetitions, one blank between words).

    With plant, every tenth document or so is first given a repetition (`planted`).
    """
    return _over(docs, params, plant, False)


def run_digests(docs: DataFrame, params: Params = Params(), plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    return _over(docs, params, plant, True)


def _over(docs: DataFrame, params: Params, plant: bool, digests: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    if digests:
        schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
        types = [pa.int64()] * 6 + [pa.string()] * 2
    else:
        schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
        types = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")] if digests else ["doc_id", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (data or b"").split()
                if plant:
                    words = planted(words, doc_id)
                runs = find_runs(numbered(words), params)
                kept = b" ".join(collapsed(words, runs))
                if digests:
                    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                    rows.append((doc_id, len(runs), *_best(runs), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((doc_id, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode()))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
