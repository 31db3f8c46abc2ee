"""Whole-text word scanning in numpy, shared by the operators that hash word windows.

A chunk of texts is joined into one byte buffer, words are found as runs of bytes other than the six ASCII white-space
bytes (``[^\\x20\\x09-\\x0D]+``), and every word gets a 64-bit polynomial hash. Windows of consecutive words get theirs
from prefix sums over the word hashes, so a window's cost doesn't depend on its length. No text is cut: chunks hold
whole documents, and a document longer than the chunk size makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text scanned at once; the arrays over a chunk take about 60 times the bytes of its words.
CHUNK_BYTES = 1_500_000

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_S = np.uint64(0xD6E8FEB86659FD93 | 1)
_S2 = np.uint64(0xC6A4A7935BD1E995 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.RandomState(20240501).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(1024, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return got


@dataclass
class Scan:
    """Words of a chunk in order: ``hashes`` of the words, ``doc`` index, and for document i the words
    ``first[i]:first[i + 1]``; ``begin`` and ``end`` are byte offsets into ``data``."""

    data: bytes
    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the hash of the k words that start there, and whether they lie in one document."""
        n = len(self.hashes)
        out, ok = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        if n >= k:
            out[: n - k + 1] = self.spans(np.arange(n - k + 1), np.arange(k, n + 1))
            last = np.repeat(self.first[1:], np.diff(self.first))
            ok = np.arange(n) + k <= last
        return out, ok

    def spans(self, start: np.ndarray, stop: np.ndarray, number: int = 0) -> np.ndarray:
        """Hashes of the word sequences start:stop; equal sequences have equal hashes wherever they stand. Hashes by
        another ``number`` (0 or 1) are independent."""
        n, base = len(self.hashes), (_S, _S2)[number]
        if not hasattr(self, "_prefix"):
            self._prefix = {}
        if number not in self._prefix:
            up, _ = _powers(base, n + 1)
            prefix = self._prefix[number] = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((mix(self.hashes + _S) if number else self.hashes) * up[:n], out=prefix[1:])
        _, down = _powers(base, n + 1)
        prefix = self._prefix[number]
        value = (prefix[stop] - prefix[start]) * down[start]
        return mix(value + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def scan(texts: list[str | None], lower: bool = False) -> Scan:
    """Scans texts together; null counts as no words. ``lower`` lower-cases A-Z before hashing."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(parts) + b" "
    raw = np.frombuffer(data, dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(_R, len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)), out=starts[1:])
    first = np.searchsorted(begin, starts)
    return Scan(data, hashes, first, begin, end)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of whole documents of about ``limit`` characters each; one document at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if texts:
        yield slice(at, len(texts))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i with i + width <= n the first position of the least value in values[i : i + width]."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    best, at, span = values, np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        span += step
    return at
