"""Segmentation kernels over byte strings: best path, n-best paths and expected counts.

A boundary between two bytes that no token of the vocabulary spans must be a
boundary of every segmentation.  Cutting a text at those boundaries gives
independent *chunks*: the best path of the text is the best paths of its chunks
joined, and its expected counts are theirs added up.  Corpora repeat chunks, so
one result per distinct chunk is kept, and whole-corpus statistics can be
computed over distinct chunks weighted by how often they occur.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from random import Random

import numpy as np

NEG = float("-inf")
CUTOFF = 50.0
REMEMBERED = 300_000


class NoPath(ValueError):
    """The vocabulary can't spell the text."""

    def __init__(self, at: int, size: int) -> None:
        super().__init__(f"no path to byte {at} of {size}")
        self.at, self.size = at, size


def log_sum_exp(a: float, b: float) -> float:
    if a == NEG or b == NEG:
        return max(a, b)
    hi, lo = (a, b) if a > b else (b, a)
    return hi if hi > lo + CUTOFF else hi + math.log1p(math.exp(lo - hi))


def digamma(x: float) -> float:
    """Raise x to 7 by the recurrence, then an asymptotic series around x - 1/2."""
    below = 0.0
    while x < 7.0:
        below += 1.0 / x
        x += 1.0
    y = x - 0.5
    u = 1.0 / (y * y)
    series = u * (1 / 24 + u * (-7 / 960 + u * (31 / 8064 - u * 127 / 30720)))
    return math.log(y) + series - below


class Lattice:
    """A vocabulary (id order) made ready for segmenting."""

    def __init__(self, values: list[bytes], scores: list[float]) -> None:
        self.values, self.scores = list(values), list(map(float, scores))
        # every prefix of a token -> its id, or -1 where it is only a prefix
        self.prefix: dict[bytes, int] = {}
        spanned = np.zeros(65536, bool)
        for i, v in enumerate(self.values):
            if not v:
                raise ValueError("a token can't be empty")
            for k in range(1, len(v)):
                self.prefix.setdefault(v[:k], -1)
            self.prefix[v] = i  # of equal tokens the last has the say
            if len(v) > 1:
                b = np.frombuffer(v, np.uint8).astype(np.int64)
                spanned[b[:-1] * 256 + b[1:]] = True
        self.spanned = spanned
        self.best: dict[bytes, tuple[int, ...]] = {}
        self.many: dict[bytes, int] = {}
        self.drawn: dict[tuple[bytes, bytes], tuple[int, ...]] = {}

    def chunks(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8).astype(np.int64)
        edge = (np.flatnonzero(~self.spanned[b[:-1] * 256 + b[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *edge], [*edge, len(text)])]

    def matches(self, text: bytes, at: int) -> list[tuple[int, int]]:
        """(end, id) of every token that text has at ``at``, shortest first."""
        out, get, n = [], self.prefix.get, len(text)
        for end in range(at + 1, n + 1):
            t = get(text[at:end])
            if t is None:
                break
            if t >= 0:
                out.append((end, t))
        return out

    def edges(self, text: bytes, dropout: float = 0.0, rng: Random | None = None) -> list[list[tuple[int, int]]]:
        """The matches at every position; those of more than a byte are left out with probability ``dropout``."""
        found = [self.matches(text, i) for i in range(len(text))]
        if dropout > 0:
            draw = (rng or Random()).random
            found = [[(e, t) for e, t in row if e - i == 1 or draw() >= dropout] for i, row in enumerate(found)]
        return found

    def viterbi(self, text: bytes, edges: list | None = None, without: int = -1) -> tuple[list[int], float]:
        """The best path and its score; of equal ones, that whose last differing token starts first."""
        n = len(text)
        score, back = [NEG] * (n + 1), [(-1, -1)] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            base = score[at]
            if base == NEG:
                continue
            for end, t in self.matches(text, at) if edges is None else edges[at]:
                if t == without:
                    continue
                s = base + self.scores[t]
                if s > score[end]:
                    score[end], back[end] = s, (at, t)
        if n and back[n][0] < 0:
            raise NoPath(n, n)
        out, at = [], n
        while at:
            at, t = back[at]
            out.append(t)
        return out[::-1], score[n]

    def encode(self, text: bytes, dropout: float = 0.0, rng: Random | None = None) -> list[int]:
        out: list[int] = []
        if dropout > 0:
            draw = (rng or Random()).random
            for c in self.chunks(text):
                out += self._dropped(c, dropout, draw)
            return out
        best = self.best
        if len(best) > REMEMBERED:
            best.clear()
        for c in self.chunks(text):
            ids = best.get(c)
            if ids is None:
                ids = tuple(self.viterbi(c)[0])
                if len(c) <= 64:
                    best[c] = ids
            out.extend(ids)
        return out

    def _dropped(self, c: bytes, dropout: float, draw: Callable[[], float]) -> list[int] | tuple[int, ...]:
        """The best path of a chunk over the matches that draws leave: one result for each chunk and outcome of its draws is kept."""
        many = self.many.get(c)
        if many is None:
            many = sum(e - i > 1 for i in range(len(c)) for e, _ in self.matches(c, i))
            if len(c) <= 64:
                if len(self.many) > REMEMBERED:
                    self.many.clear()
                self.many[c] = many
        stays = bytes([draw() >= dropout for _ in range(many)])
        ids = self.drawn.get((c, stays))
        if ids is None:
            left = iter(stays)
            ids = tuple(self.viterbi(c, [[(e, t) for e, t in self.matches(c, i) if e - i == 1 or next(left)] for i in range(len(c))])[0])
            if len(c) <= 64:
                if len(self.drawn) > REMEMBERED:
                    self.drawn.clear()
                self.drawn[c, stays] = ids
        return ids

    def _coded(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct chunks, the chunks of all texts by number, the text of each)."""
        raw = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if not raw:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        cut = ~self.spanned[b[:-1] * 256 + b[1:]]
        ends = np.cumsum(size)
        cut[ends[(ends > 0) & (ends < len(raw))] - 1] = True
        edge = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(raw)]])
        at = edge.tolist()
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(raw[i:j], len(number)) for i, j in zip(at, at[1:])), np.int64, len(at) - 1)
        return list(number), codes, np.searchsorted(ends, edge[:-1], "right")

    def _paths(self, chunks: list[bytes]) -> list[tuple[int, ...]]:
        best = self.best
        if len(best) > REMEMBERED:
            best.clear()
        out = []
        for c in chunks:
            ids = best.get(c)
            if ids is None:
                ids = tuple(self.viterbi(c)[0])
                if len(c) <= 64:
                    best[c] = ids
            out.append(ids)
        return out

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many each has); each distinct chunk is looked up once."""
        chunks, codes, text = self._coded(texts)
        paths = self._paths(chunks)
        size = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.fromiter((i for p in paths for i in p), np.int64, int(size.sum()))
        n = size[codes]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[codes], n)
        return flat[at], np.bincount(text, n, len(texts)).astype(np.int64)

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(a << 32 | b, number) of the adjacent ids within the texts."""
        chunks, codes, text = self._coded(texts)
        paths = self._paths(chunks)
        times = np.bincount(codes, minlength=len(chunks))
        inner = [(a << 32 | b, k) for p, k in zip(paths, times.tolist()) for a, b in zip(p, p[1:])]
        key, n = (np.array(x, np.int64) for x in zip(*inner)) if inner else (np.zeros(0, np.int64),) * 2
        first, last = (np.array([p[k] for p in paths], np.int64) for k in (0, -1))
        meet = np.flatnonzero(text[1:] == text[:-1])
        met, m = np.unique(last[codes[meet]] << 32 | first[codes[meet + 1]], return_counts=True) if len(meet) else (np.zeros(0, np.int64),) * 2
        key, back = np.unique(np.concatenate([key, met]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([n, m]), len(key)).astype(np.int64)

    def nbest(self, text: bytes, n: int) -> list[tuple[list[int], float]]:
        """The ``n`` best paths, best first; each position keeps its own n best ways to be reached."""
        ways: list[list[tuple[float, int, int, int]]] = [[] for _ in range(len(text) + 1)]
        ways[0] = [(0.0, -1, -1, -1)]
        for at in range(len(text)):
            if not ways[at]:
                continue
            ways[at] = heapq.nlargest(n, ways[at], key=lambda w: (w[0], -w[1]))
            for end, t in self.matches(text, at):
                ways[end] += [(w[0] + self.scores[t], at, t, k) for k, w in enumerate(ways[at])]
        out = []
        if not text:
            return [([], 0.0)]
        ways[-1] = heapq.nlargest(n, ways[-1], key=lambda w: (w[0], -w[1]))
        for s, at, t, k in ways[-1]:
            path = [t]
            while at > 0:
                _, at, t, k = ways[at][k]
                path.append(t)
            out.append((path[::-1], s))
        return out

    def expected(self, text: bytes, edges: list | None = None) -> tuple[dict[int, float], float]:
        """(expected number of each token over all segmentations, log of their total weight)."""
        n = len(text)
        if edges is None:
            edges = self.edges(text)
        ahead, behind = [NEG] * (n + 1), [NEG] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for at in range(n):
            if ahead[at] > NEG:
                for end, t in edges[at]:
                    ahead[end] = log_sum_exp(ahead[end], ahead[at] + self.scores[t])
        for at in range(n - 1, -1, -1):
            for end, t in edges[at]:
                if behind[end] > NEG:
                    behind[at] = log_sum_exp(behind[at], behind[end] + self.scores[t])
        z, out = ahead[n], {}
        if z == NEG:
            raise NoPath(n, n)
        for at in range(n):
            if ahead[at] > NEG:
                for end, t in edges[at]:
                    if behind[end] > NEG:
                        out[t] = out.get(t, 0.0) + math.exp(ahead[at] + self.scores[t] + behind[end] - z)
        return out, z

    def alternative(self, token: int) -> tuple[bool, list[int]]:
        """(always_keep, ids that would stand in for ``token``).

        If the token isn't the best way to spell itself, nothing stands in for
        it and it needn't be kept; if there is no other way, it must be.
        """
        v = self.values[token]
        same = self.prefix[v]
        try:
            other, score = self.viterbi(v, without=same)
        except NoPath:
            return True, []
        return (False, []) if score > self.scores[same] else (True, other)
