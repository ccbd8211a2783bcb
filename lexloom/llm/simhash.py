"""Near-duplicate documents: SimHash codes joined by binary tries.

A document has ``POOL`` SimHash bits of its distinct words and 128 of its distinct
word triples (a text of fewer words is one feature).  Each of ``VIEWS`` binary
tries orders the documents by a code of 64 of the word bits, drawn once and for
all.  In a trie, pairs of nodes are walked down together, and differing bits are
added up against an error budget: none on the first ``PREFIX`` levels, ``BITS``
below.  A pair that ends within the budget in any trie is a candidate; it is a
pair of near copies if its triple prints differ in at most ``CONFIRM`` bits, which
is about a Jaccard similarity of 0.5.  Copies are closed transitively, along
such pairs only, and the smallest doc_id of a group stays.

As the budget is zero on the first levels, each node at depth ``PREFIX`` is a unit
of work of its own: a document is sent to as many places as there are tries,
whatever the size of the corpus, and no near pair is lost between tasks.  A
pair that is known to be connected already, by pairs that were confirmed, is not
looked at again, so a task gives a forest and not all pairs.  A node with more
than ``HOT`` documents is salted: its documents fall into parts, and each pair of
parts is a task.  That a node is hot is seen from one in ``EVERY`` documents,
which settles how the work is cut and not what is found.

Defined cases: rows without doc_id or without any word are in no group; rows
that share a doc_id but not their text are documents of their own, told apart by
the text's hash, so that a row can be reported with its own doc_id as kept_id;
rows equal in doc_id and text are one document and share its fate; texts of one
or two words are copies only if their words are equal; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._spark import fresh, over_texts, parts, whole_partition, written
from lexloom.llm._text import U64, Words, mix64, window_hash, words

POOL, VIEWS, PREFIX, BITS, CONFIRM = 256, 48, 24, 10, 34
HOT, EVERY, LEAF = 500_000, 32, 16
PRINTS = ("w0", "w1", "w2", "w3", "t0", "t1")


def fold(features: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """SimHash of each document's features (``doc`` ascending).

    Sixteen masked adds count four bits each, in 16-bit lanes of one word.  Where
    half of the features have a bit, the bit of a hash of them all has the say.
    """
    size = np.bincount(doc, minlength=n_docs)
    start = np.cumsum(size) - size
    # a lane holds up to 65535, so long documents are counted in pieces
    pieces = np.maximum(1, -(-size // 60_000))
    owner = np.repeat(np.arange(n_docs), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = start[owner] + nth * 60_000
    live = size[owner] > 0
    counts = np.zeros((n_docs, 64), np.int64)
    if len(features):
        lane = U64(0x0001000100010001)
        for s in range(16):
            got = np.add.reduceat((features >> U64(s)) & lane, at[live])
            for q in range(4):
                np.add.at(counts[:, s + 16 * q], owner[live], ((got >> U64(16 * q)) & U64(0xFFFF)).astype(np.int64))
    both = np.zeros(n_docs, U64)
    if len(features):
        with np.errstate(over="ignore"):
            np.add.at(both, owner[live], np.add.reduceat(features, at[live]))
    lean = 2 * counts - size[:, None] + ((mix64(both)[:, None] >> np.arange(64, dtype=U64)) & U64(1)).astype(np.int64)
    return ((lean > 0).astype(U64) << np.arange(64, dtype=U64)).sum(1, dtype=U64)


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    h = window_hash(w.hash, n)
    ok = w.left()[: len(h)] >= n
    return h[ok], w.doc[: len(h)][ok]


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's features once, in order."""
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _prints(w: Words) -> np.ndarray:
    """The prints of every text, one row each: four words of word bits, two of triple bits."""
    n = len(w.bounds) - 1
    single, of = _distinct(w.hash, w.doc)
    triple, by = _distinct(*_grams(w, 3))
    few = np.setdiff1d(np.arange(n), by)
    at = np.searchsorted(by, few)
    triple, by = np.insert(triple, at, sequence_hash(w)[few]), np.insert(by, at, few)
    with np.errstate(over="ignore"):
        cols = [fold(mix64(single + U64(k)), of, n) for k in range(4)] + [fold(mix64(triple + U64(k)), by, n) for k in range(2)]
    return np.stack(cols, 1)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    return _prints(words(texts))


def sequence_hash(w: Words) -> np.ndarray:
    """Equal for texts of the same words in the same order."""
    out = np.zeros(len(w.bounds) - 1, U64)
    with np.errstate(over="ignore"):
        at = (np.arange(len(w.hash)) - w.bounds[w.doc]).astype(U64)
        np.add.at(out, w.doc, mix64(w.hash + at * U64(0x9E3779B97F4A7C15)))
    return mix64(out ^ mix64(np.diff(w.bounds).astype(U64)))


def orders() -> np.ndarray:
    """The bits of each view's code, most significant first."""
    return np.stack([np.random.default_rng(1000 + v).permutation(POOL)[:64] for v in range(VIEWS)])


def codes(prints: np.ndarray) -> Iterator[np.ndarray]:
    """Each view's codes of documents with word bits ``prints`` (n x 4)."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    columns = np.ascontiguousarray(bits.T)
    for order in orders():
        yield np.packbits(columns[order], axis=0).T.copy().view(">u8")[:, 0].astype(U64)


def apart(t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of the triple prints of rows i and j."""
    return np.bitwise_count(t[i] ^ t[j]).sum(1, dtype=np.int64)


class Trees:
    """Which rows are known to be of one component; unions are carried out in bulk."""

    def __init__(self, code: np.ndarray, n: int) -> None:
        self.code, self.root, self.turn = code, np.arange(n), 0
        self._i, self._j, self._size = [], [], 0

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.code[rows]]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.of(i), self.of(j)
        apart = i != j
        if apart.any():
            self._i.append(i[apart])
            self._j.append(j[apart])
            self._size += len(self._i[-1])
            if self._size > 4096:
                self.settle()

    def settle(self) -> None:
        if self._size:
            self.root = forest(np.concatenate(self._i), np.concatenate(self._j), len(self.root))[self.root]
            self._i, self._j, self._size = [], [], 0
            self.turn += 1


def neighbours(fp: np.ndarray, group: np.ndarray, budget: int, turns: int = 4, reach: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the pairs within ``budget``: rows that are close in the order of their bits, rotated ``turns`` ways."""
    for k in range(turns):
        by = U64(k * 64 // turns)
        order = np.lexsort(((fp << by) | (fp >> (U64(64) - by)) if k else fp, group))
        for step in range(1, reach + 1):
            i, j = order[:-step], order[step:]
            ok = (group[i] == group[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            yield i[ok], j[ok]


def _row_pairs(alo: np.ndarray, n: np.ndarray, blo: np.ndarray, m: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows alo..alo+n and blo..blo+m of each pair of nodes, about ``most`` at a time."""
    row = np.repeat(alo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    start, size = np.repeat(blo, n), np.repeat(m, n)
    total = np.cumsum(size)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        k = size[at:end]
        first = np.cumsum(k) - k
        yield np.repeat(row[at:end], k), np.arange(int(k.sum())) + np.repeat(start[at:end] - first, k)
        at = end


def trie_walk(fp: np.ndarray, group: np.ndarray, budget: int, most: int = 50_000, trees: Trees | None = None, top: int = 63) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j (after sorting) of one group within ``budget`` differing bits, a run at a time.

    A trie node is a range of the sorted rows that agree on the bits so far.
    A pair of nodes splits into its (up to) four pairs of children, of which
    those on different sides spend one bit of the budget.  Walks go down in
    runs of at most ``most`` node pairs and hand their pairs on as they find
    them, so memory depends neither on the number of pairs nor on that of nodes.
    With ``trees``, node pairs whose rows are all known to be of one component
    are left out: what they hold joins nothing.  The rows of a group agree on
    the bits above ``top``.  Below nodes that are single rows, or nearly, there
    is nothing to share: their rows are compared as wholes.
    """
    order = np.lexsort((fp, group)).astype(np.int32)
    f, g = fp[order], group[order]
    lo = (np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)).astype(np.int32)
    hi = np.append(lo[1:], len(g)).astype(np.int32)
    roots = (hi - lo) > 1
    ones: dict[int, np.ndarray] = {}
    turn, tree, change = -1, order, order
    stack = [(top, lo[roots], hi[roots], lo[roots], hi[roots], np.full(int(roots.sum()), budget, np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, left = stack.pop()
        if len(alo) > most:
            stack += [(bit, alo[:-most], ahi[:-most], blo[:-most], bhi[:-most], left[:-most])]
            alo, ahi, blo, bhi, left = (x[-most:].copy() for x in (alo, ahi, blo, bhi, left))
        if trees is not None:
            if turn != trees.turn:
                turn, tree = trees.turn, trees.of(order)
                change = np.append(0, np.cumsum(tree[1:] != tree[:-1]))
            ok = (tree[alo] != tree[blo]) | (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo])
            alo, ahi, blo, bhi, left = (x[ok] for x in (alo, ahi, blo, bhi, left))
        n, m = (ahi - alo).astype(np.int64), (bhi - blo).astype(np.int64)
        leaf = n * m <= LEAF if bit >= 0 else np.ones(len(n), bool)
        if leaf.any():
            for i, j in _row_pairs(alo[leaf], n[leaf], blo[leaf], m[leaf]):
                ok = (np.bitwise_count(f[i] ^ f[j]) <= budget) & (i < j)
                yield order[i[ok]], order[j[ok]]
            inner = ~leaf
            alo, ahi, blo, bhi, left = (x[inner] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            continue
        # rows under a node are sorted, so its zeros at this bit come first
        if bit not in ones:
            ones[bit] = np.zeros(len(f) + 1, np.int32)
            np.cumsum((f >> U64(bit)) & U64(1), out=ones[bit][1:])
        acc = ones[bit]
        amid, bmid = ahi - (acc[ahi] - acc[alo]), bhi - (acc[bhi] - acc[blo])
        same = (alo == blo) & (ahi == bhi)
        nxt = []
        for x, y, z, u, cost, skip in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, same)):
            ok = (y > x) & (u > z) & (left >= cost)
            if skip is not None:
                ok &= ~skip
            # a node with itself needs two rows to hold a pair
            ok &= ~((x == z) & (y == u) & (y - x == 1))
            nxt.append((x[ok], y[ok], z[ok], u[ok], (left[ok] - cost).astype(np.int8)))
        stack.append((bit - 1, *(np.concatenate(c) for c in zip(*nxt))))


def trie_join(fp: np.ndarray, group: np.ndarray, budget: int, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``trie_walk`` as a whole."""
    found = list(trie_walk(fp, group, budget, most))
    i, j = (np.concatenate(c).astype(np.int64) if found else np.zeros(0, np.int64) for c in (list(zip(*found)) or [(), ()]))
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0..n-1's component, by label passing with jumps."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for k in (i, j):
            np.minimum.at(root, root[k], low)
            np.minimum.at(root, k, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def near_pairs(nodes: DataFrame, bits: int = BITS, confirm: int = CONFIRM, hot: int = HOT, every: int = EVERY) -> DataFrame:
    """Edges (src, dst) among rows (id, prints): of each task a forest that spans its near pairs."""
    spark = nodes.sparkSession
    n = nodes.count()
    nodes = nodes.select("id", *PRINTS)

    def keys(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for v, code in enumerate(codes(np.stack([rows.column(k).to_numpy().view(U64) for k in range(1, 5)], 1))):
            yield code, (code >> U64(64 - PREFIX)).astype(np.int64) | v << PREFIX

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, key in keys(rows):
                k, c = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "n"])

    heavy: dict[int, int] = {}
    if n > hot:  # else no node can be hot; at most VIEWS * n / hot of them are
        some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(tally, "key long, n long")
        some = some.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * every > hot)
        heavy = {r[0]: -(-2 * r[1] * every // hot) for r in some.collect()}
    held = spark.sparkContext.broadcast((np.array(sorted(heavy), np.int64), np.array([heavy[k] for k in sorted(heavy)], np.int64)))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, salts = held.value
        for rows in batches:
            ident = rows.column(0).to_numpy()
            for code, key in keys(rows):
                row, part = np.arange(len(key)), np.zeros(len(key), np.int64)
                if len(of):
                    k = np.minimum(np.searchsorted(of, key), len(of) - 1)
                    times = np.where(of[k] == key, salts[k], 1)
                    row = np.repeat(row, times)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    own = (mix64(ident.view(U64)) % times.astype(U64)).astype(np.int64)[row]
                    part = np.minimum(own, nth) * times[row] + np.maximum(own, nth)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(part), pa.array(code[row].view(np.int64)), *(rows.column(c).take(take) for c in (0, 5, 6))], ["key", "part", "code", "id", "t0", "t1"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = whole_partition(batches)
        if held is None:
            return
        key, part = held.column("key").to_numpy(), held.column("part").to_numpy()
        o = np.lexsort((part, key))
        group = np.empty(len(o), np.int64)
        group[o] = np.cumsum(np.append(True, (np.diff(key[o]) != 0) | (np.diff(part[o]) != 0))) - 1
        shared = np.flatnonzero(np.bincount(group)[group] > 1)  # a document alone at its node has no pair
        if not len(shared):
            return
        held, group = held.take(pa.array(shared)), group[shared]
        fp, t = held.column("code").to_numpy().view(U64), np.stack([held.column(c).to_numpy().view(U64) for c in ("t0", "t1")], 1)
        ids, code = np.unique(held.column("id").to_numpy(), return_inverse=True)
        trees = Trees(code, len(ids))
        for first in (True, False):  # cheap pairs first, which spare the walk most of the rest
            for i, j in neighbours(fp, group, bits) if first else trie_walk(fp, group, bits, trees=trees, top=63 - PREFIX):
                ok = apart(t, i, j) <= confirm
                trees.join(i[ok], j[ok])
            trees.settle()
        moved = np.flatnonzero(trees.root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[trees.root[moved]])], ["src", "dst"])

    wide = nodes.mapInArrow(expand, "key long, part long, code long, id long, t0 long, t1 long")
    return wide.repartition(parts(spark, n * VIEWS, 1_000_000), "key", "part").mapInArrow(join, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component of the graph, for every id in an edge that isn't its root.

    Large-star and small-star rounds; each round's edges are written to the
    shared folder, and it ends when a round changes nothing.
    """
    edges = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges")
    total = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = total(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def prints_of(docs: DataFrame) -> DataFrame:
    def fn(rows: pa.RecordBatch, texts: list) -> dict:
        w = words(texts)
        ok = pa.array(np.diff(w.bounds) > 0)
        own = zip((*PRINTS, "id"), (*_prints(w).T, sequence_hash(w)))
        return {"doc_id": rows.column(0).filter(ok), "text_hash": rows.column(2).filter(ok), **{c: pa.array(np.ascontiguousarray(v).view(np.int64)).filter(ok) for c, v in own}}

    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return over_texts(docs, "text", f"doc_id long, text_hash long, {', '.join(f'{c} long' for c in PRINTS)}, id long", fn)


def _gone(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, text_hash, kept_id) of every document that is a near copy of one that stays."""
    prints = written(prints_of(docs), "prints")
    # equal word sequences have equal prints and are one node, so that copies by the thousand cost one row
    nodes = prints.groupBy("id").agg(*(F.min(c).alias(c) for c in PRINTS))
    roots = components(near_pairs(written(nodes, "nodes"), **kw))
    named = prints.join(roots, "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))
    named = written(named, "named")
    kept = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count("*").alias("n")).where("n > 1")
    return named.join(kept, "root").where(F.struct("doc_id", "text_hash") != F.col("k")).select("doc_id", "text_hash", F.col("k.doc_id").alias("kept_id"))


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, kept_id): every document that is a near copy of another, and the document of its group that stays."""
    return _gone(docs, **kw).select("doc_id", "kept_id").distinct()


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """The documents less those that are a near copy of one that stays."""
    owner, of_text = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = _gone(docs, **kw).select(F.col("doc_id").alias(owner), F.col("text_hash").alias(of_text))
    return docs.join(gone, (docs["doc_id"] == gone[owner]) & (F.xxhash64(docs["text"]) == gone[of_text]), "left_anti")


__all__ = ["codes", "components", "deduplicated", "fingerprints", "near_duplicates", "near_pairs", "trie_join"]
