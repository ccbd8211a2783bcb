"""Benchmark decontamination by a broadcast set of normalised n-grams.

Every benchmark item gives its windows of ``GRAM`` words (lower-cased runs of
letters and digits); an item of ``SHORTEST`` to ``GRAM - 1`` words gives itself
as one window.  Training documents are scanned window by window against the
sorted hashes; a hit is verified by comparing the words themselves.  The set is
three arrays and one buffer of the items' words, so it takes about 26 bytes a word.  The
verified windows of a document and an item are united to spans.  A document of
whose words more than ``MAX_SHARE`` lie in spans goes; others lose the spans.

The set is broadcast only if the benchmark has at most ``BROADCAST_WORDS``
words; a larger benchmark is joined by hash instead, with the same result: only
hashes travel, and the windows that meet are verified in the texts.

Defined cases: rows without doc_id give no findings but lose their spans, or go,
like any other (cutting needs no id); items without
item_id or under ``SHORTEST`` words match nothing; null and empty texts
match nothing; several items with the same window all report it; rows that
repeat a doc_id are scanned each for itself, and equal findings reported once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._cut import cut_words, with_texts
from lexloom.llm._spark import _slices, fresh, over_texts, spread
from lexloom.llm._text import U64, Words, union_spans, window_hash, words

GRAM, SHORTEST, MAX_SHARE, BROADCAST_WORDS = 8, 4, 0.5, 2_000_000
FOUND = "doc_id long, item_id long, start_word long, end_word long, start_char long, end_char long, n_words long"


def normalised(text: str, w: Words, at: int, n: int) -> list[str]:
    """Words at .. at+n of a single text, lower-cased as for hashing."""
    out = []
    for a, b in zip(w.start[at : at + n].tolist(), w.end[at : at + n].tolist()):
        word = text[a:b]
        low = word.lower()
        out.append(low if len(low) == len(word) else "".join(c.lower() if len(c.lower()) == 1 else c for c in word))
    return out


class Grams:
    """The benchmark's windows: by size, ascending hashes with item and first word of each; the words in one buffer."""

    def __init__(self, items: list[tuple[int, str]], gram: int, shortest: int) -> None:
        held: list[bytes] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        at = 0
        for item, text in items:
            w = words([text])
            n = min(gram, len(w.hash))
            if n < shortest:
                continue
            h = window_hash(w.hash, n)
            found.setdefault(n, []).append((h, np.full(len(h), item, np.int64), np.arange(at, at + len(h))))
            held += [x.encode("utf-8", "surrogatepass") + b"\0" for x in normalised(text, w, 0, len(w.hash))]
            at += len(w.hash)
        self.text = b"".join(held)
        self.edge = np.append(0, np.cumsum([len(x) for x in held])).astype(np.int64)
        self.by_size = {}
        for n, each in found.items():
            h, item, first = (np.concatenate(x) for x in zip(*each))
            o = np.argsort(h, kind="stable")
            self.by_size[n] = h[o], item[o], first[o].astype(np.int32)

    def hits(self, texts: list[str | None]) -> tuple[Words, dict[tuple[int, int], list]]:
        """Verified windows (start, size) by (text number, item)."""
        w = words(texts)
        out: dict[tuple[int, int], list] = {}
        left = w.left()
        for n, (keys, items, first) in self.by_size.items():
            h = window_hash(w.hash, n)
            k = np.searchsorted(keys, h)
            at = np.flatnonzero((keys[np.minimum(k, len(keys) - 1)] == h) & (left[: len(h)] >= n))
            for i, j in zip(at.tolist(), k[at].tolist()):
                d = int(w.doc[i])
                lo = int(w.bounds[d])
                have = _joined_words(normalised(texts[d], w, i, n))
                while j < len(keys) and keys[j] == h[i]:
                    if self.text[self.edge[first[j]] : self.edge[first[j] + n]] == have:
                        out.setdefault((d, int(items[j])), []).append((i - lo, n))
                    j += 1
        return w, out


def _joined_words(each: list[str]) -> bytes:
    return b"".join(x.encode("utf-8", "surrogatepass") + b"\0" for x in each)


def _spans(w: Words, found: dict[tuple[int, int], list], ids: pa.Array) -> dict:
    cols: dict[str, list] = {c: [] for c in ("d", "item_id", "start_word", "end_word")}
    for (d, item), wins in found.items():
        a = np.array([x for x, _ in wins])
        s, e = union_spans(a, a + np.array([n for _, n in wins]), int(w.bounds[d + 1] - w.bounds[d]))
        cols["d"] += [d] * len(s)
        cols["item_id"] += [item] * len(s)
        cols["start_word"] += s.tolist()
        cols["end_word"] += e.tolist()
    d, s, e = (np.array(cols[c], np.int64) for c in ("d", "start_word", "end_word"))
    lo = w.bounds[d]
    return {"doc_id": ids.take(pa.array(d)), "item_id": cols["item_id"], "start_word": s, "end_word": e, "start_char": w.start[lo + s] if len(d) else d, "end_char": w.end[lo + e - 1] if len(d) else d, "n_words": e - s}


def _items(bench: DataFrame) -> DataFrame:
    return bench.select("item_id", "text").where("item_id is not null and text is not null")


def _fits(bench: DataFrame, limit: int) -> bool:
    # an upper bound on its words: one for every two characters
    return (_items(bench).agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * limit


def contamination(docs: DataFrame, bench: DataFrame, gram: int = GRAM, shortest: int = SHORTEST, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The verified spans: doc_id, item_id, words start_word..end_word, the same in characters."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    if _fits(bench, broadcast_words):
        held = docs.sparkSession.sparkContext.broadcast(Grams([(r[0], r[1]) for r in _items(bench).collect()], gram, shortest))
        return over_texts(docs, "text", FOUND, lambda rows, texts: _spans(*held.value.hits(texts), rows.column(0))).distinct()
    met = _met(docs, _items(bench), gram, shortest)
    full = docs.join(met, F.xxhash64(docs["text"]) == met["of_text"]).select("doc_id", "text", "wins")

    def fn(rows: pa.RecordBatch, texts: list) -> dict:
        w = words(texts)
        return _spans(w, _verified(texts, w, rows.column(2).to_pylist()), rows.column(0))

    return over_texts(full, "text", FOUND, fn).distinct()


def _met(docs: DataFrame, bench: DataFrame, gram: int, shortest: int) -> DataFrame:
    """(of_text, wins): for the hash of a text its windows whose hash an item has, with the item and its words.

    Equal texts have equal windows, so those are told by the text's hash; a
    window of another text with that hash doesn't outlast verification.
    """

    def sizes(rows: pa.RecordBatch, texts: list) -> dict:
        n = np.diff(words(texts).bounds)
        return {"n": np.unique(np.minimum(n[n >= shortest], gram))}

    lengths = sorted(r[0] for r in over_texts(bench, "text", "n long", sizes).distinct().collect())  # at most ``gram``

    def windows(of_items: bool):
        def fn(rows: pa.RecordBatch, texts: list) -> dict:
            w = words(texts)
            left, n_words = w.left(), np.diff(w.bounds)
            found = []
            for n in lengths:
                h = window_hash(w.hash, n)
                ok = left[: len(h)] >= n
                if of_items and n < gram:
                    ok &= n_words[w.doc[: len(h)]] == n
                i = np.flatnonzero(ok)
                found.append((h[i].view(np.int64), w.doc[i], i, np.full(len(i), n)))
            key, of, i, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
            out = {"key": key, "id": rows.column(0).take(pa.array(of)), "at": i - w.bounds[of], "n": n}
            if of_items:
                out["gram"] = [_joined_words(normalised(texts[d], w, k, size)) for d, k, size in zip(of.tolist(), i.tolist(), n.tolist())]
            return out

        return fn

    schema = "key long, id long, at long, n long"
    left = over_texts(docs.select(F.xxhash64("text").alias("id"), "text").where("text is not null"), "text", schema, windows(False))
    right = over_texts(bench, "text", f"{schema}, gram binary", windows(True)).select("key", F.col("n").alias("size"), F.col("id").alias("item_id"), "gram").distinct()
    both = left.join(right, (left["key"] == right["key"]) & (left["n"] == right["size"])).select(left["id"].alias("of_text"), F.struct("at", "n", "item_id", "gram").alias("win")).distinct()
    return both.groupBy("of_text").agg(F.collect_list("win").alias("wins"))


def _verified(texts: list[str | None], w: Words, wins: list) -> dict[tuple[int, int], list]:
    """As ``Grams.hits``, from the windows that met by hash."""
    out: dict[tuple[int, int], list] = {}
    for d, each in enumerate(wins):
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        for x in each or ():
            if lo + x["at"] + x["n"] <= hi and _joined_words(normalised(texts[d], w, lo + x["at"], x["n"])) == bytes(x["gram"]):
                out.setdefault((d, x["item_id"]), []).append((x["at"], x["n"]))
    return out


def decontaminated(docs: DataFrame, bench: DataFrame, gram: int = GRAM, shortest: int = SHORTEST, max_share: float = MAX_SHARE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents without their contaminated spans; one with more than ``max_share`` of its words in spans, or none left, goes."""
    at, names, held = docs.columns.index("text"), len(docs.columns), None
    if _fits(bench, broadcast_words):
        held = docs.sparkSession.sparkContext.broadcast(Grams([(r[0], r[1]) for r in _items(bench).collect()], gram, shortest))
    else:
        met = _met(docs, _items(bench), gram, shortest)
        met = met.select(F.col("of_text").alias(fresh(docs, "of_text")), F.col("wins").alias(fresh(docs, "wins")))
        docs = docs.join(met, F.xxhash64(docs["text"]) == met[met.columns[0]], "left").drop(met.columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = rows.column(at)
            for a, b in _slices(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))):
                part = rows.slice(a, b - a)
                texts = part.column(at).to_pylist()
                if held is not None:
                    w, found = held.value.hits(texts)
                else:
                    w = words(texts)
                    found = _verified(texts, w, part.column(names).to_pylist())
                spans: dict[int, list] = {}
                for (d, _), wins in found.items():
                    spans.setdefault(d, []).extend((x, x + n) for x, n in wins)
                yield _rewrite(part, pa.schema(list(part.schema)[:names]), texts, spans, w, max_share)

    return spread(docs).mapInArrow(run, T.StructType(docs.schema.fields[:names]))


def _rewrite(rows: pa.RecordBatch, schema: pa.Schema, texts: list, spans: dict[int, list], w: Words, max_share: float) -> pa.RecordBatch:
    keep = np.ones(rows.num_rows, bool)
    for d, ab in spans.items():
        n = int(w.bounds[d + 1] - w.bounds[d])
        a, b = (np.minimum(np.array(x, np.int64), n) for x in zip(*ab))
        s, e = union_spans(a, b, n)
        lost = int((e - s).sum())
        keep[d] = lost < n and lost <= max_share * n
        if keep[d]:
            texts[d] = cut_words(texts[d], w, d, a, b)
    return with_texts(rows, texts, [d for d in spans if keep[d]], schema).filter(pa.array(keep))


__all__ = ["Grams", "contamination", "decontaminated"]
