"""Elias-Fano sequences in numpy: compact, memory-mappable, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each word."""
    at, r = np.zeros(len(w), np.int64), r.copy()
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count((w >> at.astype(U64)) & U64((1 << width) - 1)).astype(np.int64)
        up = r >= n
        r -= np.where(up, n, 0)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of n integers, in about 2 + log2(largest / n) bits each.

    The low bits of the values lie packed; the high parts are a bit vector of
    unary gaps.  ``ones`` holds the set bits before each word of it.
    """

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.shift, self.low, self.high = n, shift, low, high
        self.ones = np.append(0, np.cumsum(np.bitwise_count(high).astype(np.int64)))
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self._at = np.ndarray((max(len(low) - 7, 0),), "<u8", buffer=low, strides=(1,)) if len(low) >= 8 else None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        high = np.zeros((n + (top >> shift)) // 64 + 1, U64)
        at = (values >> U64(shift)) + np.arange(n, dtype=U64)
        np.bitwise_or.at(high, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        packed = []
        for a in range(0, n if shift else 0, 1 << 16):  # a multiple of 8 values: whole bytes
            part = values[a : a + (1 << 16)]
            bits = ((part[:, None] >> np.arange(shift, dtype=U64)) & U64(1)).astype(np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        return cls(n, shift, np.concatenate([*packed, np.zeros(8, np.uint8)]), high)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.shift], np.int64), self.low, self.high]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift or not len(i):
            return np.zeros(len(i), U64)
        bit = i.astype(np.int64) * self.shift
        return (self._at[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.shift) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(np.asarray(self.high[word]), i - self.ones[word])
        return ((at - i).astype(U64) << U64(self.shift)) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part under ``high``."""
        k = high - 1  # the zero that ends the bucket before
        out = np.zeros(len(high), np.int64)
        live = np.flatnonzero(k >= 0)
        past = live[k[live] >= len(self.high) * 64 - self.n]
        out[past] = self.n
        live = live[k[live] < len(self.high) * 64 - self.n]
        z = k[live]
        word = np.searchsorted(self.zeros, z, "right") - 1
        out[live] = np.minimum(word * 64 + _select_in_word(~np.asarray(self.high[word]), z - self.zeros[word]) - z, self.n)
        return out

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x, n if there is none; one bucket's low bits are searched by halving."""
        x = np.asarray(x).astype(U64)
        high, want = (x >> U64(self.shift)).astype(np.int64), x & U64((1 << self.shift) - 1)
        lo, hi = self._before(high), self._before(high + 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x, else -1."""
        at = self.next_geq(x)
        ok = at < self.n
        got = np.full(len(at), -1, np.int64)
        hit = np.flatnonzero(ok)
        same = self[at[hit]] == np.asarray(x).astype(U64)[hit]
        got[hit[same]] = at[hit[same]]
        return got


def save(path: str, arrays: list[np.ndarray]) -> None:
    """All arrays in one file, each aligned to 8 bytes; whole or not at all."""
    import os
    import uuid

    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as f:
        head = [len(arrays)]
        at = 8 * (1 + 3 * len(arrays))
        for a in arrays:
            head += [ord(a.dtype.char), len(a), at]
            at += -(-a.nbytes // 8) * 8
        f.write(np.array(head, np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def load(path: str) -> list[np.ndarray]:
    """The arrays of ``save``, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 * (1 + 3 * n)].view(np.int64).reshape(n, 3)
    return [np.asarray(raw[at : at + size * np.dtype(chr(kind)).itemsize]).view(chr(kind)) for kind, size, at in head.tolist()]
