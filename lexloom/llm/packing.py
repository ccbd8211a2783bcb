"""Packing documents into fixed windows, by non-negative least squares.

A document of n tokens gives n // WINDOW full windows and a remainder.  The
remainders of a group of documents form a histogram over ``BINS`` classes of
length (rounded up).  All combinations of at most ``DEPTH`` classes that fill a
window are enumerated, non-negative least squares finds how often each should
repeat to use up the histogram, the repeats are rounded down, and what is left
is packed greedily, longest first, into the window with least room.

Groups are hashes of doc_id, text and place in the input, as many as keep each at
about ``GROUP`` documents, so each is solved by itself and nothing is gathered,
even where one doc_id, or none, is on many rows.

Defined cases: a document without tokens (null or empty text) takes no place; rows
with a null or repeated doc_id are packed each for itself; equal lengths are
taken in order of doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._bpe import TOKENIZER, chunks
from lexloom.llm._spark import over_texts

WINDOW, BINS, DEPTH, GROUP = 2048, 64, 3, 20_000
PACKED = "pack_id long, slot int, doc_id long, start_token long, n_tokens long"


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |ax - b|, x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, np.abs(atb).max(initial=0.0))
    for _ in range(30 * n + 30):
        grad = np.where(active, -np.inf, atb - ata @ x)
        k = int(np.argmax(grad))
        if grad[k] <= tol:
            break
        active[k] = True
        while True:
            s = np.zeros(n)
            idx = np.flatnonzero(active)
            s[idx] = np.linalg.lstsq(ata[np.ix_(idx, idx)], atb[idx], rcond=None)[0]
            bad = idx[s[idx] <= 1e-12]
            if not len(bad):
                break
            gap = x[bad] - s[bad]
            step = float(np.min(np.where(gap > 0, x[bad] / np.where(gap > 0, gap, 1), 0)))
            x += step * (s - x)
            active[active & (x <= 1e-12)] = False
            x[~active] = 0
        x = s
    else:
        raise ArithmeticError("the least squares did not settle")
    return x


def combos(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most ``depth`` classes 1..bins with sum ``bins``."""
    return [c for d in range(1, depth + 1) for c in combinations_with_replacement(range(1, bins + 1), d) if sum(c) == bins]


def _combos(bins: int, depth: int, held: dict = {}) -> tuple[list, np.ndarray]:  # noqa: B006
    if (bins, depth) not in held:
        all_of = combos(bins, depth)
        a = np.zeros((bins, len(all_of)))
        for j, c in enumerate(all_of):
            for b in c:
                a[b - 1, j] += 1
        held[bins, depth] = all_of, a
    return held[bins, depth]


def pack(lengths: np.ndarray, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """The pack number of every piece (1 <= length <= window); pieces are taken in the given order within a class."""
    bins = min(bins, window)
    all_of, a = _combos(bins, depth)
    cls = -(-lengths * bins // window)
    stock = [np.flatnonzero(cls == b + 1).tolist()[::-1] for b in range(bins)]
    have = np.array([len(s) for s in stock])
    weight = np.sqrt(np.arange(1, bins + 1))  # a long piece left over wastes more
    x = nnls(a * weight[:, None], have * weight) if have.any() else np.zeros(len(all_of))
    out, n = np.full(len(lengths), -1), 0
    for j in np.argsort(-x, kind="stable").tolist():
        use = a[:, j].astype(int)
        need = np.flatnonzero(use)
        times = min([int(x[j] + 1e-6), *(len(stock[b]) // use[b] for b in need)])
        for _ in range(times):
            for b in need:
                for _ in range(use[b]):
                    out[stock[b].pop()] = n
            n += 1
    left = np.flatnonzero(out < 0)
    room: list[tuple[int, int]] = []  # (tokens free, pack), sorted
    for i in left[np.argsort(-lengths[left], kind="stable")].tolist():
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        free, p = room.pop(k) if k < len(room) else (window, n)
        n += p == n
        out[i] = p
        if free > size:
            insort(room, (free - size, p))
    return out


def packed(docs: DataFrame, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH, group: int = GROUP, tokenizer: str = TOKENIZER) -> DataFrame:
    """(pack_id, slot, doc_id, start_token, n_tokens): every token of every document in exactly one place."""
    if window < 1 or bins < 1 or depth < 1:
        raise ValueError("window, bins and depth must be positive")
    n_groups = max(1, -(-docs.count() // group))

    def count(rows: pa.RecordBatch, texts: list) -> dict:
        return {"doc_id": rows.column(0), "n": chunks(tokenizer).counts(texts), "h": rows.column(2)}

    sizes = over_texts(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")), "text", "doc_id long, n long, h long", count).where("n > 0")
    sizes = sizes.select("doc_id", "n", F.pmod(F.xxhash64("h", F.spark_partition_id()), F.lit(n_groups)).alias("g"))

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        ids, n, g = t.column("doc_id"), t.column("n").to_numpy(), t.column("g")[0].as_py()
        pieces = -(-n // window)
        row = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        size = np.minimum(window, n[row] - start)
        short = np.flatnonzero(size < window)
        full = np.flatnonzero(size == window)
        which = np.empty(len(row), np.int64)
        which[full] = np.arange(len(full))
        which[short] = pack(size[short], window, bins, depth) + len(full)
        o = np.argsort(which, kind="stable")
        p = which[o]
        new = np.append(True, p[1:] != p[:-1])
        slot = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        return pa.table({"pack_id": pa.array(p + (g << 32), pa.int64()), "slot": pa.array(slot, pa.int32()), "doc_id": ids.take(pa.array(row[o])), "start_token": pa.array(start[o], pa.int64()), "n_tokens": pa.array(size[o], pa.int64())})

    return sizes.groupBy("g").applyInArrow(solve, PACKED)
