"""Vectorised hashing of words and shingles straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_STEPS = _rng.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or _powers[0].size < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_P, _P_INVERSE):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near values end far apart."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in bytes) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and last bytes of the words, and the index of each row's first word (n + 1 of them)."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offs[1:] > offs[:-1])
    at = offs[:-1][filled]
    first[at] = inside[at]
    at = offs[1:][filled] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.searchsorted(starts, offs)


def byte_sums(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums (n + 1) of a polynomial in the bytes, and the powers that shift a sum to zero."""
    p, q = powers(buf.size + 1)
    sums = np.zeros(buf.size + 1, dtype=U64)
    np.cumsum((_LOWER if lower else _BYTES).take(buf) * p[: buf.size], out=sums[1:])
    return sums, q


def span_hashes(sums: np.ndarray, q: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes starts..ends-1: equal bytes, equal hash."""
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64) * U64(_P))


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the index of each row's first word (n + 1)."""
    starts, last, rows = word_bounds(buf, offs)
    sums, q = byte_sums(buf, lower)
    return span_hashes(sums, q, starts, last + 1), rows


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of the row's five-word shingles).

    A row of one to four words has its whole sequence as one shingle; a row
    without words has none.
    """
    for lo, hi, buf, offs in slices(texts):
        words, rows = word_hashes(buf, offs)
        if words.size >= SHINGLE_WORDS:
            end = words.size - SHINGLE_WORDS + 1
            h = words[:end] * _STEPS[0]
            for k in range(1, SHINGLE_WORDS):
                h += words[k : end + k] * _STEPS[k]
            h = mix(h)
        for i in range(hi - lo):
            a, b = int(rows[i]), int(rows[i + 1])
            if b - a >= SHINGLE_WORDS:
                s = np.sort(h[a : b - SHINGLE_WORDS + 1])
                yield lo + i, s[np.concatenate(([True], s[1:] != s[:-1]))] if s.size > 1 else s
            elif b > a:
                parts = np.append(words[a:b], U64(b - a)) * np.append(_STEPS[: b - a], _STEPS[SHINGLE_WORDS])
                yield lo + i, mix(parts.sum(dtype=U64, keepdims=True))
            else:
                yield lo + i, np.zeros(0, dtype=U64)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
