"""Numpy helpers for arrays of variable-length runs and for their hashes."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def take_runs(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start[0] : start[0] + length[0]], then the next run, and so on, as one array."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(start - (ends - length), length)]


def chunks(texts: list, limit: int):
    """(first, last + 1) ranges of about ``limit`` characters; one long text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_TABLES.get("p", ())) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("q", _Q)):
            a = np.full(size, base, U)
            a[0] = 1
            _TABLES[name] = np.multiply.accumulate(a)
    return _TABLES["p"][:n], _TABLES["q"][:n]


#: Slices of more bytes than this are hashed one by one.
LONG = 512
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def words_at(values: np.ndarray) -> np.ndarray:
    """The eight bytes (little-endian) from every byte of an array on; beyond the end are zeros."""
    padded = np.zeros(values.nbytes + 8, np.uint8)
    padded[: values.nbytes] = np.ascontiguousarray(values).view(np.uint8)
    return np.ndarray((values.nbytes + 1,), "<u8", padded, 0, (1,))


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes raw[start:end]. Eight bytes at a time go through a bijective mix,
    so unlike in a polynomial no pattern within a slice cancels out."""
    view, size = words_at(raw), end - start
    h = mix(size.astype(U) * U(_P) + U(1))
    live = np.arange(len(start))
    long = np.flatnonzero(size > LONG)
    if len(long):
        data = memoryview(np.ascontiguousarray(raw))
        for i in long.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[int(start[i]) : int(end[i])], digest_size=8).digest(), "little")
        live = np.flatnonzero(size <= LONG)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (view[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` neighbouring hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = mix(np.arange(11, 11 + size, dtype=U)) | U(1)
    total = hashes[:n] * factors[0]
    for k in range(1, size):
        total += hashes[k : k + n] * factors[k]
    return mix(total + U(size))


class Rolling:
    """64-bit polynomial hashes of any slices of one array of unsigned integers.

    Modulo 2**64 some patterned slices of a thousand values and more collide whatever the values,
    so equal hashes of slices are no proof: use them to find what is then compared."""

    def __init__(self, values: np.ndarray):
        p, self.q = powers(len(values) + 1)
        if values.dtype == np.uint8:
            scrambled = mix(np.arange(1, 257, dtype=U))[values]
        else:
            scrambled = (values.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
            scrambled ^= scrambled >> U(31)
        scrambled *= p[:-1]
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(scrambled, out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]; equal slices have equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[size:] - self.sums[:n]) * self.q[:n] + U(size))
