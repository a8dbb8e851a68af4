"""Vectorised hashing of words, word runs and character runs with numpy.

Texts of a batch are joined, and all their words are hashed at once: a polynomial in the bytes, each byte replaced by
a random 64-bit number, summed cumulatively, so a word's hash is a difference of two sums."""

from __future__ import annotations

import functools

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240607


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good spread (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.cache
def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(_SEED))


@functools.cache
def _space_table() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0]] = True
    return out


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def segments(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``data[start:end]``; it depends on the bytes alone."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_bytes_table()[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: ``hash``, ``row`` (of its text), ``start`` and ``end`` in the joined bytes, and
    the bytes themselves. Texts are joined by a line feed."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _space_table()[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    edges = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return segments(data, start, end), np.searchsorted(edges, start, side="right"), start, end, data


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes, len(h) - n + 1 of them."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _P + h[i : len(h) - n + 1 + i]
    return mix(out)


def row_runs(h: np.ndarray, row: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of each row, as (row, hash) sorted by row, then hash.

    A row of fewer than ``n`` hashes has one run, all of them."""
    if len(h) >= n:
        r, first, last = runs(h, n), row[: len(h) - n + 1], row[n - 1 :]
        ok = first == last
        r, at = r[ok], first[ok]
    else:
        r, at = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    count = np.bincount(row, minlength=rows)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        starts = np.searchsorted(row, few)
        extra = []
        for s, c in zip(starts, count[few], strict=True):
            x = np.uint64(c)
            for y in h[s : s + c]:
                x = np.uint64((int(x) * int(_P) + int(y)) & 0xFFFFFFFFFFFFFFFF)
            extra.append(x)
        r, at = np.r_[r, mix(np.array(extra, np.uint64))], np.r_[at, few]
    order = np.lexsort((r, at))
    r, at = r[order], at[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (at[1:] != at[:-1])] if len(r) else np.zeros(0, bool)
    return at[new], r[new]


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
