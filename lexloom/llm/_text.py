"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of alphanumeric characters, compared after simple
lower-casing (one code point to one code point, so character offsets never
move).  Whole batches of texts are turned into flat numpy arrays; nothing here
loops over characters or words in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_TOP = 0x32400  # beyond this Unicode assigns no letters or digits
_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers = np.ones(1, U64)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_STEP = U64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _luts() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        norm = np.zeros(0x110000, np.uint32)
        for cp in range(_TOP):
            ch = chr(cp)
            if ch.isalnum():
                low = ch.lower()
                norm[cp] = ord(low) if len(low) == 1 else cp
        _tables = norm, mix64(np.arange(1, _TOP + 1, dtype=U64))
    return _tables


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            last = _powers[-1] * _BASE
            _powers = np.concatenate([_powers, _powers * last])
    return _powers


@dataclass
class Words:
    """Words of a batch: document d owns entries bounds[d]:bounds[d+1]."""

    hash: np.ndarray  # uint64, equal for equal normalised words
    start: np.ndarray  # first character, within the document
    end: np.ndarray  # one past the last character
    doc: np.ndarray
    bounds: np.ndarray

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return self.bounds[self.doc + 1] - np.arange(len(self.doc))


def words(texts: list[str | None]) -> Words:
    """All words of ``texts`` (None counts as empty)."""
    norm_of, key_of = _luts()
    texts = [t or "" for t in texts]
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=base[1:])
    raw = ("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass")
    norm = norm_of[np.frombuffer(raw, np.uint32)]
    on = norm != 0
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    if len(on) and on[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, base))) if texts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, base)
    size = end - start
    if len(start):
        first = np.cumsum(size) - size
        rel = np.arange(int(size.sum())) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(key_of[norm[on]] * _power(int(size.max()))[rel], first)
        h = mix64(h ^ size.astype(U64))
    else:
        h = np.zeros(0, U64)
    return Words(h, start - base[doc], end - base[doc], doc, bounds)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` entries of ``h``; by doubling, so log n passes."""
    if len(h) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        done, size, block, width, factor = None, 0, h, 1, _STEP
        while True:
            if n & width:
                if done is None:
                    done, size = block, width
                else:
                    done = block[: len(h) - size - width + 1] * _to(size) + done[width : len(h) - size + 1]
                    size += width
            width *= 2
            if width > n:
                return mix64(done + U64(n))
            half = width // 2
            block = block[: len(h) - width + 1] * factor + block[half : len(h) - half + 1]
            factor = factor * factor


def _to(n: int) -> np.uint64:
    return U64(pow(int(_STEP), n, 1 << 64))


def slices(texts: list[str | None], limit: int = 1_500_000):
    """(from, to) ranges of ``texts`` of about ``limit`` characters; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def segment_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over bounds[d]:bounds[d+1] for every d (empty ranges give 0)."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def union_spans(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges within 0..n, as disjoint sorted ranges; touching ones join."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    on = np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge[0::2], edge[1::2]
