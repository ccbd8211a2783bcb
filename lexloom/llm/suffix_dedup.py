"""Repeated passages across documents, by run-length compressed BWT.

A passage window is ``LENGTH`` consecutive words.  If its words occur more
than once in the corpus, its occurrence with the smallest (doc_id, position)
stays and every other is marked; runs of marked windows whose first occurrence
lies in the same document are one span.

Work is routed by minimizer.  The window's smallest ``ANCHOR``-word hash picks
its group, neighbouring windows with one anchor travel together as a piece, and anchors
that occur once anywhere are dropped before any text moves; equal windows have
equal anchors, so no repeat is missed.  A task indexes the first piece of each of
its groups: a Burrows-Wheeler transform in runs, with suffix-array samples at both
ends of each run.  The other pieces are streamed backwards through the index
for their matching statistics: a position that matches ``LENGTH`` words or more is
a window that the indexed piece has, earlier than any other.  What does not match is
indexed and streamed in the same way, in ``ROUNDS`` rounds, and what is left of
groups with more variants than that is indexed as a whole.  The index itself
keeps, beside the runs, only the windows that it has more than once.

A group of over ``HOT_WORDS`` words (a licence line in millions of documents) is
not brought to one task: its windows meet by two hashes of all their words, in
aggregations that Spark combines before the shuffle and may split.

Defined cases: rows without doc_id are neither marked nor matched, and stay; a
null or short text has no window; rows that share a doc_id but not their text
are documents of their own, in the order of the text's hash, and may mark each
other; rows equal in doc_id and text are one document; a text that
loses all its words is dropped by ``cut``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._cut import cut_words, with_texts
from lexloom.llm._spark import fresh, over_texts, parts, whole_partition, written
from lexloom.llm._suffix import lcp_array, suffix_array
from lexloom.llm._text import U64, Words, mix64, window_hash, words

LENGTH, ANCHOR, INDEX_WORDS, ROUNDS, HOT_WORDS = 50, 16, 400_000, 3, 5_000_000


class RunLengthIndex:
    """A run-length BWT of ``seq`` (its last symbol must occur once), with samples at run ends.

    The suffix array and its ranks are dropped once the runs are known.  Prefixes
    of the sequence are compared by sums of hashes, up to ``length`` symbols.
    """

    def __init__(self, seq: np.ndarray, length: int) -> None:
        sa, levels = suffix_array(seq)
        n = len(seq)
        # windows that occur again, and where they occur first
        kind = np.cumsum(lcp_array(sa, levels, length) < length) - 1
        first = np.full(int(kind[-1]) + 1, n)
        np.minimum.at(first, kind, sa)
        again = first[kind] != sa
        o = np.argsort(sa[again])
        self.again, self.first = sa[again][o], first[kind][again][o]
        self.symbols, code = np.unique(seq, return_inverse=True)
        bwt = code[sa - 1]
        self.start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.last = np.append(self.start[1:], n) - 1
        self.head = bwt[self.start]
        self.at_start, self.at_last = sa[self.start], sa[self.last]
        size = self.last - self.start + 1
        o = np.argsort(self.head, kind="stable")
        self.base = np.empty(len(o), np.int64)
        self.base[o] = np.cumsum(size[o]) - size[o]  # LF of each run's first row
        self.by_symbol = self.head[o] * len(o) + o
        self.n, self.steps = n, [1 << k for k in range(max(length, 1).bit_length() - 1, -1, -1)]
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.append(U64(1), np.full(n, 0x9E3779B97F4A7C15, U64)))
            self.sums = np.append(U64(0), np.cumsum(mix64(seq.astype(U64) + U64(1)) * self.power[:n]))

    def runs(self) -> int:
        return len(self.head)

    def firsts(self, at: np.ndarray) -> np.ndarray:
        """The first place of the windows at places ``at``."""
        if not len(self.again):
            return at
        k = np.minimum(np.searchsorted(self.again, at), len(self.again) - 1)
        return np.where(self.again[k] == at, self.first[k], at)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes i and j; exact below ``length``."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        with np.errstate(over="ignore"):
            for step in self.steps:
                ok = np.flatnonzero((i + step <= self.n) & (j + step <= self.n))
                x, y = i[ok], j[ok]
                a = (self.sums[x + step] - self.sums[x]) * self.power[self.n - x]
                same = ok[a == (self.sums[y + step] - self.sums[y]) * self.power[self.n - y]]
                i[same] += step
                j[same] += step
                out[same] += step
        return out

    def lf(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        return self.base[run] + row - self.start[run]

    def matching_statistics(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) for every position of the patterns text[start:start+size].

        length is that of the longest prefix of the rest of the pattern that
        occurs in the indexed text (exact below the index's own length), place where it does.  All
        patterns step backwards together.  Where the next symbol differs from
        the row's, the walk moves to the nearest run of that symbol above or
        below, whichever sampled end shares the longer prefix.
        """
        runs = len(self.head)
        place_of, length_of = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        sym = np.searchsorted(self.symbols, text)
        known = sym < len(self.symbols)
        known[known] = self.symbols[sym[known]] == text[known]
        o = np.argsort(-size, kind="stable")
        start, size = start[o], size[o]
        q, ln, pos = np.zeros(len(o), np.int64), np.zeros(len(o), np.int64), np.full(len(o), self.at_start[0])
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "right"))
            p = start[:m] + size[:m] - t
            c, row, length, at = sym[p], q[:m].copy(), ln[:m].copy(), pos[:m].copy()
            run = np.searchsorted(self.start, row, "right") - 1
            off = np.flatnonzero((self.head[run] != c) | ~known[p])
            if len(off):
                key = c[off] * runs + run[off]
                k = np.searchsorted(self.by_symbol, key)
                best, new_row, new_at, new_run = (np.full(len(off), -1, np.int64) for _ in range(4))
                for side, ends, rows in ((k - 1, self.at_last, self.last), (k, self.at_start, self.start)):
                    ok = (side >= 0) & (side < runs) & known[p[off]]
                    r = self.by_symbol[np.where(ok, side, 0)]
                    ok &= r // runs == c[off]
                    r = np.where(ok, r % runs, 0)
                    cand, cand_row = ends[r], rows[r]
                    share = np.where(length[off] > 0, np.where(cand == at[off], self.n, self.common(at[off], cand)), 0)
                    take = ok & (share > best)
                    best, new_row, new_at, new_run = np.where(take, share, best), np.where(take, cand_row, new_row), np.where(take, cand, new_at), np.where(take, r, new_run)
                found = best >= 0
                length[off] = np.where(found, np.minimum(length[off], best), -1)
                row[off], at[off], run[off] = np.where(found, new_row, row[off]), np.where(found, new_at, at[off]), np.where(found, new_run, run[off])
            q[:m] = np.where(length >= 0, self.lf(row, run), row)
            pos[:m] = np.where(length >= 0, at - 1, at)
            ln[:m] = length + 1
            place_of[p], length_of[p] = pos[:m], ln[:m]
        return place_of, length_of


def pieces(w: Words, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each run of windows that share an anchor occurrence; every window is in one."""
    n = len(w.hash) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(U64)
    h = window_hash(w.hash, anchor)
    low = U64((1 << 28) - 1)
    best, size, span = (h & ~low) | np.arange(len(h), dtype=U64), 1, length - anchor + 1
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:n], best[span - size : span - size + n])
    at = (best & low).astype(np.int64)
    valid = w.left()[:n] >= length
    idx = np.flatnonzero(valid)
    if not len(idx):
        return none, none, none.astype(U64)
    new = np.append(True, (np.diff(idx) > 1) | (np.diff(at[idx]) != 0))
    first = idx[new]
    last = idx[np.append(np.flatnonzero(new)[1:], len(idx)) - 1]
    return first, last, h[at[first]]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after another."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def first_places(text: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``text`` that begins a window of the pieces start, size: the first place of an equal window, else -1.

    Pieces are in order of their group, and of their age within it; equal windows are in one group.
    """
    out, turn = np.full(len(text), -1), 0
    while len(start):
        lead = np.append(True, group[1:] != group[:-1]) if turn < ROUNDS else np.ones(len(start), bool)
        a, n = start[lead], size[lead]
        # each indexed piece ends with a symbol of its own
        ends = np.cumsum(n)
        seq = np.insert(text[ranges(a, n)] + len(a), ends, np.arange(len(a)))
        place = np.insert(ranges(a, n), ends, -1)
        index = RunLengthIndex(seq, length)
        own = ranges(ends - n + np.arange(len(a)), n - length + 1)
        out[place[own]] = place[index.firsts(own)]
        start, size, group = start[~lead], size[~lead], group[~lead]
        if not len(start):
            break
        at, match = index.matching_statistics(text + len(a), start, size)
        pos = ranges(start, size - length + 1)
        piece = np.repeat(np.arange(len(start)), size - length + 1)
        hit = match[pos] >= length
        out[pos[hit]] = place[index.firsts(at[pos[hit]])]
        pos, piece = pos[~hit], piece[~hit]
        new = np.append(True, (np.diff(pos) != 1) | (np.diff(piece) != 0)) if len(pos) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        start, group = pos[head], group[piece[head]]
        size = np.diff(np.append(head, len(pos))) + length - 1
        turn += 1
    return out


def mark(key: np.ndarray, doc: np.ndarray, at: np.ndarray, codes: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Marked runs of windows among pieces sorted by (key, doc, at): doc_id, first and last window, document of the first occurrence."""
    which, distinct = pd.factorize(np.array(codes, dtype=object))
    size = np.array([len(c) // 4 for c in distinct], np.int64)
    lead = np.full(len(distinct), len(codes))  # a piece's first carrier is its earliest
    np.minimum.at(lead, which, np.arange(len(codes)))
    text = np.frombuffer(b"".join(distinct), np.uint32).astype(np.int64)
    begin = np.cumsum(size) - size
    first = first_places(text, begin, size, key[lead], length)
    windows = size - length + 1
    pos = ranges(begin, windows)
    src = first[pos]
    of = np.searchsorted(begin, src, "right") - 1
    lead_doc, lead_at = doc[lead[of]], at[lead[of]] + src - begin[of]
    # back to every piece, copies included
    w_begin = np.cumsum(windows) - windows
    n = windows[which]
    e = ranges(w_begin[which], n)
    r = np.repeat(np.arange(len(codes)), n)
    here = at[r] + e - w_begin[which][r]
    hit = (lead_doc[e] != doc[r]) | (lead_at[e] != here)
    r, here, src = r[hit], here[hit], lead_doc[e][hit]
    cut = np.append(True, (r[1:] != r[:-1]) | (np.diff(here) != 1) | (src[1:] != src[:-1])) if len(r) else np.zeros(0, bool)
    z = np.append(np.flatnonzero(cut)[1:], len(r)) - 1 if len(r) else np.zeros(0, np.int64)
    return {"doc_id": doc[r[cut]], "a": here[cut], "z": here[z], "first_doc_id": src[cut]}


def _spans(docs: DataFrame, length: int, anchor: int, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, first_doc_id) of every marked span."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null")

    def seen(rows: pa.RecordBatch, texts: list) -> dict:
        w = words(texts)
        a, z, h = pieces(w, length, anchor)
        of = pa.array(w.doc[a])
        return {"key": h.view(np.int64), "doc_id": rows.column(0).take(of), "text_hash": rows.column(2).take(of), "n": z - a + length}

    anchors = written(over_texts(docs, "text", "key long, doc_id long, text_hash long, n int", seen), "anchors")
    shared = anchors.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 1").select("key", "n")
    shared = written(shared, "shared")
    many = shared.where(F.col("n") > hot_words)
    n_hot, amount = shared.agg(F.count_if(F.col("n") > hot_words), F.sum(F.when(F.col("n") <= hot_words, F.col("n")))).first()

    def carriers(keys: DataFrame) -> DataFrame:
        """The documents that have an anchor of ``keys``, with those anchors."""
        wanted = anchors.select("key", F.col("doc_id").alias("id"), F.col("text_hash").alias("of_text")).join(keys, "key").groupBy("id", "of_text").agg(F.collect_set("key").alias("keys"))
        return docs.join(wanted, (docs["doc_id"] == wanted["id"]) & (docs["text_hash"] == wanted["of_text"])).select("doc_id", "text", "keys", "text_hash")

    def chosen(w: Words, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, z, h = pieces(w, length, anchor)
        of = np.repeat(np.arange(len(keys)), np.asarray(pa.compute.list_value_length(keys)))
        want = mix64(np.asarray(pa.compute.list_flatten(keys)).view(U64)) ^ mix64(of.astype(U64) + U64(1))
        ok = np.isin(mix64(h) ^ mix64(w.doc[a].astype(U64) + U64(1)), want)
        return a[ok], z[ok], h[ok]

    def send(rows: pa.RecordBatch, texts: list) -> dict:
        w = words(texts)
        a, z, h = chosen(w, rows.column(2))
        size = z - a + length
        body = w.hash[ranges(a, size)].astype(np.uint32)
        offsets = np.append(0, np.cumsum(size) * 4).astype(np.int32)
        codes = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
        own = pa.array(w.doc[a])
        return {"key": h.view(np.int64), "doc_id": rows.column(0).take(own), "text_hash": rows.column(3).take(own), "at": a - w.bounds[w.doc[a]], "codes": codes}

    sent = over_texts(carriers(shared.where(F.col("n") <= hot_words)), "text", "key long, doc_id long, text_hash long, at long, codes binary", send)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = whole_partition(batches)
        if held is None:
            return
        held = held.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("at", "ascending")])
        key, ident, text, at = (held.column(c).to_numpy() for c in ("key", "doc_id", "text_hash", "at"))
        o = np.lexsort((text, ident))
        new = np.append(True, (np.diff(ident[o]) != 0) | (text[o][1:] != text[o][:-1]))
        doc = np.empty(len(o), np.int64)
        doc[o] = np.cumsum(new) - 1
        ident, text = ident[o][new], text[o][new]
        size = pa.compute.binary_length(held.column("codes")).to_numpy() // 4
        edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        total = np.append(0, np.cumsum(size))
        i = 0
        while i < len(edge) - 1:  # an index over whole groups, of about INDEX_WORDS
            j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + INDEX_WORDS, "right")) - 1)
            lo, hi = edge[i], edge[j]
            got = mark(key[lo:hi], doc[lo:hi], at[lo:hi], held.column("codes").slice(lo, hi - lo).to_pylist(), length)
            own, src = got.pop("doc_id"), got.pop("first_doc_id")
            yield pa.RecordBatch.from_pydict({"doc_id": ident[own], "text_hash": text[own], **got, "first_doc_id": ident[src], "first_text": text[src]})
            i = j

    runs = sent.repartition(parts(docs.sparkSession, amount or 0, 2_000_000), "key").mapInArrow(join, "doc_id long, text_hash long, a long, z long, first_doc_id long, first_text long").distinct()
    if n_hot:

        def spread(rows: pa.RecordBatch, texts: list) -> dict:
            w = words(texts)
            a, z, _ = chosen(w, rows.column(2))
            at = ranges(a, z - a + 1)
            own = pa.array(w.doc[at])
            hashes = {c: window_hash(h, length)[at].view(np.int64) for c, h in (("h", w.hash), ("g", mix64(w.hash)))}
            return {"doc_id": rows.column(0).take(own), "text_hash": rows.column(3).take(own), "at": at - w.bounds[w.doc[at]], **hashes}

        each = written(over_texts(carriers(many), "text", "doc_id long, text_hash long, at long, h long, g long", spread).distinct(), "hot")
        firsts = each.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("f"), F.count("*").alias("c")).where("c > 1")
        met = each.join(firsts, ["h", "g"]).where(F.struct("doc_id", "text_hash", "at") != F.col("f"))
        runs = runs.unionAll(met.select("doc_id", "text_hash", F.col("at").alias("a"), F.col("at").alias("z"), F.col("f.doc_id"), F.col("f.text_hash"))).distinct()
    pair = ["doc_id", "text_hash", "first_doc_id", "first_text"]
    w = Window.partitionBy(*pair).orderBy("a")
    runs = runs.withColumn("new", F.coalesce((F.col("a") > F.lag("z").over(w) + 1).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(w))
    spans = runs.groupBy(*pair, "k").agg(F.min("a").alias("start_word"), (F.max("z") + length).alias("end_word"))
    return spans.select("doc_id", "text_hash", "start_word", "end_word", "first_doc_id")


def repeated_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id) of every marked span; end_word is exclusive."""
    return _spans(docs, length, anchor, hot_words).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def cut(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The documents without their marked spans; one that has no word left goes."""
    owner, of_text = fresh(docs, "span_doc"), fresh(docs, "span_text")
    spans = _spans(docs, length, anchor).groupBy(F.col("doc_id").alias(owner), F.col("text_hash").alias(of_text))
    spans = spans.agg(F.collect_list(F.struct("start_word", "end_word")).alias(fresh(docs, "spans")))
    both = docs.join(spans, (docs["doc_id"] == spans[owner]) & (F.xxhash64(docs["text"]) == spans[of_text]), "left").drop(owner, of_text)
    at, names = both.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            schema = pa.schema(list(rows.schema)[:names])
            spans_of = rows.column(names)
            touched = np.flatnonzero(np.asarray(spans_of.is_valid()))
            texts = rows.column(at).to_pylist()
            keep = np.ones(rows.num_rows, bool)
            for k in touched.tolist():
                text = texts[k] or ""
                w = words([text])
                ab = [(s["start_word"], s["end_word"]) for s in spans_of[k].as_py()]
                a, b = (np.minimum(np.array(x, np.int64), len(w.hash)) for x in zip(*ab))
                texts[k] = cut_words(text, w, 0, a, b)
                keep[k] = len(words([texts[k]]).hash) > 0
            yield with_texts(rows, texts, touched.tolist(), schema).filter(pa.array(keep))

    return both.mapInArrow(run, docs.schema)
