"""Trigram language-model scores from an Elias-Fano trie over the whole corpus.

Counts come from every word of every document.  Probabilities are smoothed by
hierarchical Dirichlet priors,

    P(w3 | w1 w2) = (c(w1 w2 w3) + MU P(w3 | w2)) / (c(w1 w2) + MU)
    P(w3 | w2)    = (c(w2 w3) + MU P(w3)) / (c(w2) + MU)
    P(w3)         = (c(w3) + 1) / (N + V + 1),

and kept as 8-bit codes, -8 log2 P rounded and at most 255 (32 bits).  A
document's score is the mean code of its words from the second on; its first
context is a mark for the beginning of a document.

Layout.  Words are numbered by sorted hash in Elias-Fano vocabulary files.
Trigrams are routed by their middle word, so that all the counts that its
probability needs meet in one shard; a middle word too frequent for a shard is
spread by its first word, and its pairs are counted beforehand.  A shard's
levels are: middle words; their successors w3, with P(w3 | w2); their
predecessors w1; and for each (w2, w1) the places of its w3 among the
successors of w2.  Each level is a monotone sequence with monotone pointers to
the next, in one memory-mapped file of the shared folder.  Shards score the
words routed to them and return integer sums, which are exact in any order.

Defined cases: rows without doc_id train the model but are not scored; a
document with fewer than two words has n_scored 0 and a null score; rows that
repeat a doc_id are scored each for itself and all counted; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _eliasfano as ef
from lexloom.llm._eliasfano import EliasFano
from lexloom.llm._spark import _slices, local_path, over_texts, parts, scratch_path, spread, written
from lexloom.llm._text import U64, mix64, words

MU, STEP, SHARD_WORDS, MOST_SHARDS, VOCAB_WORDS, BLOCK_WORDS = 32.0, 8, 1_000_000, 20_000, 2_000_000, 1_000_000


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEP * np.log2(p)), 255).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    return 2.0 ** (-code.astype(float) / STEP)


class Vocabulary:
    """Words' hashes in Elias-Fano files by their top bits; a word's number is its rank."""

    def __init__(self, path: str, bits: int, sizes: list[int], n_words: int) -> None:
        self.path, self.bits, self.first, self.n_words = path, bits, np.append(0, np.cumsum(sizes)), n_words
        self.size = int(self.first[-1])
        self._open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def part(self, k: int) -> tuple[EliasFano, np.ndarray]:
        if k not in self._open:
            *seq, counts = ef.load(f"{self.path}/vocab-{k}")
            self._open[k] = EliasFano.of(*seq), counts
        return self._open[k]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of distinct hashes in ascending order."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        top = (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        edge = np.searchsorted(top, np.arange(2**self.bits + 1))
        for k in np.unique(top).tolist():
            a, b = edge[k], edge[k + 1]
            seq, n = self.part(k)
            at = seq.find(h[a:b] & U64((1 << (64 - self.bits)) - 1))
            ok = at >= 0
            ids[a:b][ok] = at[ok] + self.first[k]
            counts[a:b][ok] = n[at[ok]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending word numbers."""
        out = np.zeros(len(ids), np.int64)
        edge = np.searchsorted(ids, self.first)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            out[edge[k] : edge[k + 1]] = self.part(k)[1][ids[edge[k] : edge[k + 1]] - self.first[k]]
        return out

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.n_words + self.size + 1)


def vocabulary(docs: DataFrame, path: str) -> Vocabulary:
    def count(rows: pa.RecordBatch, texts: list) -> dict:
        h, n = np.unique(words(texts).hash, return_counts=True)
        return {"h": h.view(np.int64), "n": n}

    table = written(over_texts(docs, "text", "h long, n long", count).groupBy("h").agg(F.sum("n").alias("n")), "words")
    size, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (size // VOCAB_WORDS).bit_length())

    def save(t: pa.Table) -> pa.Table:
        h, n = t.column("h").to_numpy().view(U64), t.column("n").to_numpy()
        o = np.argsort(h)
        k = t.column("k")[0].as_py()
        seq = EliasFano.build(h[o] & U64((1 << (64 - bits)) - 1))
        ef.save(f"{path}/vocab-{k}", [*seq.arrays(), n[o]])
        return pa.table({"k": pa.array([k], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    part = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    sizes = dict(map(tuple, table.withColumn("k", part).groupBy("k").applyInArrow(save, "k int, n long").collect()))
    for k in set(range(2**bits)) - set(sizes):
        ef.save(f"{path}/vocab-{k}", [*EliasFano.build(np.zeros(0, U64)).arrays(), np.zeros(0, np.int64)])
    return Vocabulary(path, bits, [sizes.get(k, 0) for k in range(2**bits)], total)


class Routes:
    """The shard of a trigram: by its middle word, and for a frequent one by its first word too."""

    def __init__(self, hot: dict[int, int], n_words: int, shard_words: int) -> None:
        self.plain = max(1, -(-n_words // shard_words))
        self.hot = np.array(sorted(hot), np.int64)
        self.split = np.array([-(-hot[w] // shard_words) for w in self.hot.tolist()], np.int64)
        self.base = self.plain + np.cumsum(self.split) - self.split
        self.total = self.plain + int(self.split.sum())

    def of(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        shard = (mix64(w2.astype(U64)) % U64(self.plain)).astype(np.int64)
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, w2), len(self.hot) - 1)
            hit = np.flatnonzero(self.hot[k] == w2)
            k = k[hit]
            shard[hit] = self.base[k] + (mix64(w1[hit].astype(U64) + U64(1)) % self.split[k].astype(U64)).astype(np.int64)
        return shard


def trigrams(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w1, w2, w3, document) of every word but each document's first, and the words of each document."""
    w = words(texts)
    h, inverse = np.unique(w.hash, return_inverse=True)
    ids = vocab.lookup(h)[0][inverse]
    at = np.arange(len(ids)) - w.bounds[w.doc]
    i = np.flatnonzero(at >= 1)
    w1 = np.where(at[i] >= 2, ids[np.maximum(i - 2, 0)], vocab.size)  # the mark for a beginning
    return w1, ids[i - 1], ids[i], w.doc[i], np.diff(w.bounds)


class Trie:
    """One shard's levels."""

    NAMES = ("mid", "succ", "succ_at", "pred", "pred_at", "tri", "tri_at")

    def __init__(self, seqs: dict[str, EliasFano], succ_code: np.ndarray, ctx_code: np.ndarray, tri_code: np.ndarray, span: int) -> None:
        self.__dict__.update(seqs)
        self.succ_code, self.ctx_code, self.tri_code, self.span = succ_code, ctx_code, tri_code, span

    @classmethod
    def build(cls, w1, w2, w3, n, vocab: Vocabulary, pairs: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> Trie:  # noqa: ANN001
        """From distinct trigrams in order of (w2, w1, w3) and their counts; ``pairs`` has all successors and counts of middle words that are spread over shards."""
        span = vocab.size + 1
        mid, m = np.unique(w2, return_inverse=True)
        key, inverse = np.unique(m * span + w3, return_inverse=True)
        c2 = np.bincount(inverse, n)
        owner = key // span
        for k, word in enumerate(mid.tolist()):
            if pairs and word in pairs:
                mine = np.flatnonzero(owner == k)
                succ, total = pairs[word]
                c2[mine] = total[np.searchsorted(succ, key[mine] % span)]
        all_of = np.bincount(owner, c2, len(mid))
        for k, word in enumerate(mid.tolist()):
            if pairs and word in pairs:
                all_of[k] = pairs[word][1].sum()
        ids, back = np.unique(key % span, return_inverse=True)
        p2 = (c2 + MU * vocab.p1(vocab.counts_of(ids))[back]) / (all_of[owner] + MU)
        code2 = quantised(p2)
        succ_first = np.searchsorted(owner, np.arange(len(mid) + 1))
        ctx, c = np.unique(m * span + w1, return_inverse=True)
        c12 = np.bincount(c, n)
        p3 = (n + MU * probability(code2[inverse])) / (c12[c] + MU)
        place = inverse - succ_first[m]  # of w3 among the successors of w2
        seqs = {
            "mid": mid, "succ": key, "succ_at": succ_first, "pred": ctx, "pred_at": np.searchsorted(ctx // span, np.arange(len(mid) + 1)),
            "tri": c * span + place, "tri_at": np.searchsorted(c, np.arange(len(ctx) + 1)),
        }
        return cls({k: EliasFano.build(v) for k, v in seqs.items()}, code2, quantised(MU / (c12 + MU)), quantised(p3), span)

    def save(self, path: str) -> None:
        seqs = [a for k in self.NAMES for a in getattr(self, k).arrays()]
        ef.save(path, [*seqs, self.succ_code, self.ctx_code, self.tri_code, np.array([self.span], np.int64)])

    @classmethod
    def load(cls, path: str) -> Trie:
        a = ef.load(path)
        return cls({k: EliasFano.of(*a[3 * i : 3 * i + 3]) for i, k in enumerate(cls.NAMES)}, *a[21:24], int(a[24][0]))

    def codes(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, unseen: np.ndarray | None = None) -> np.ndarray:
        """The code of each trigram; an unseen one backs off to its pair and the context's weight, an unseen pair to ``unseen`` (255 by default)."""
        out = np.full(len(w1), 255, np.int64) if unseen is None else unseen.astype(np.int64)
        m = self.mid.find(w2)
        ok = np.flatnonzero(m >= 0)
        m = m[ok]
        s, p = self.succ.find(m * self.span + w3[ok]), self.pred.find(m * self.span + w1[ok])
        pair = s >= 0
        low = np.where(pair, self.succ_code[np.maximum(s, 0)].astype(np.int64), out[ok])
        known = p >= 0
        low = np.where(known, np.minimum(low + self.ctx_code[np.maximum(p, 0)], 255), low)
        both = np.flatnonzero(pair & known)
        place = s[both] - self.succ_at[m[both]].astype(np.int64)
        t = self.tri.find(p[both] * self.span + place)
        hit = t >= 0
        low[both[hit]] = self.tri_code[t[hit]]
        out[ok] = low
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return np.array([len(arrays[0])], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, k: int) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = np.frombuffer(pa.decompress(blob[8:], 4 * k * n, codec="zstd", asbytes=True), np.uint8).reshape(k, 4, n)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.uint32)[..., 0].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary):
    """(ids, w1, w2, w3, document, words of each document) of about BLOCK_WORDS."""
    held: list = []
    size = n_docs = 0
    for rows in batches:
        col = rows.column(1)
        for a, b in _slices(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))):
            w1, w2, w3, doc, n = trigrams(col.slice(a, b - a).to_pylist(), vocab)
            held.append((rows.column(0).slice(a, b - a), *(x.astype(np.uint32) for x in (w1, w2, w3, doc + n_docs)), n))
            size, n_docs = size + len(w1), n_docs + b - a
            if size >= BLOCK_WORDS:
                yield pa.concat_arrays([h[0] for h in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])
                held, size, n_docs = [], 0, 0
    if held:
        yield pa.concat_arrays([h[0] for h in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])


def _hot_pairs(docs: DataFrame, vocab: Vocabulary, hot: np.ndarray, path: str) -> None:
    """Files of the successors, with counts, of each middle word that is spread over shards."""

    def count(rows: pa.RecordBatch, texts: list) -> dict:
        _, w2, w3, _, _ = trigrams(texts, vocab)
        ok = np.isin(w2, hot)
        key, n = np.unique(w2[ok] * (vocab.size + 1) + w3[ok], return_counts=True)
        return {"w2": key // (vocab.size + 1), "w3": key % (vocab.size + 1), "n": n}

    def save(t: pa.Table) -> pa.Table:
        w3, n, k = t.column("w3").to_numpy(), t.column("n").to_numpy(), t.column("w2")[0].as_py()
        o = np.argsort(w3)
        ef.save(f"{path}/pairs-{k}", [w3[o], n[o]])
        return pa.table({"w2": pa.array([k], pa.int64())})

    pairs = over_texts(docs, "text", "w2 long, w3 long, n long", count).groupBy("w2", "w3").agg(F.sum("n").alias("n"))
    pairs.groupBy("w2").applyInArrow(save, "w2 long").count()


def scores(docs: DataFrame, shard_words: int = SHARD_WORDS, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_scored, bits, bits_per_word, perplexity) of every document, under the model of them all."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = local_path(model_path or scratch_path(spark, "ngrams"))
    vocab = vocabulary(docs.select("text"), path)
    shard_words = max(shard_words, vocab.n_words // MOST_SHARDS)
    hot: dict[int, int] = {}
    for k in range(2**vocab.bits):
        n = vocab.part(k)[1]
        for i in np.flatnonzero(n > shard_words).tolist():
            hot[int(vocab.first[k]) + i] = int(n[i])
    vocab._open.clear()
    routes = Routes(hot, vocab.n_words, shard_words)
    if hot:
        _hot_pairs(docs.select("text"), vocab, routes.hot, path)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, (ids, w1, w2, w3, doc, n) in enumerate(_blocks(batches, vocab)):
            origin = part << 24 | nth
            shard = routes.of(w1, w2)
            o = np.argsort(shard << 32 | w2, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(shard[o]) != 0)) if len(o) else np.zeros(0, np.int64)
            blobs, shards = [], []
            for a, b in zip(edge, np.append(edge[1:], len(o))):
                k = o[a:b]
                blobs.append(_pack(np.diff(w2[k], prepend=np.uint32(0)), w1[k], w3[k], doc[k]))
                shards.append(int(shard[k[0]]))
            # the block's documents themselves travel as shard -1, straight to the sums
            blobs.append(pa.BufferOutputStream())
            with pa.ipc.new_stream(blobs[-1], pa.schema([("id", pa.int64()), ("n", pa.int64())])) as f:
                f.write_batch(pa.record_batch([ids.cast(pa.int64()), pa.array(n)], ["id", "n"]))
            blobs[-1] = blobs[-1].getvalue().to_pybytes()
            yield pa.record_batch([pa.array([*shards, -1 - origin], pa.int64()), pa.array([origin] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "origin", "blob"])

    def score(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        if shard < 0:
            return t.select(["origin", "blob"]).append_column("docs", pa.array([True], pa.bool_()))
        origins, blobs = t.column("origin").to_numpy(), t.column("blob").to_pylist()
        each = []
        for b in blobs:
            g = _unpack(b, 4).astype(np.uint32)
            g[0] = np.cumsum(g[0], dtype=np.uint32)
            each.append(g)
        size = np.array([g.shape[1] for g in each])
        w2, w1, w3, doc = np.concatenate(each, axis=1)
        del each, blobs
        o = np.lexsort((w3, w1, w2))
        a, b, c = w1[o].astype(np.int64), w2[o].astype(np.int64), w3[o].astype(np.int64)
        new = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0))
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(o)))
        a, b, c = a[head], b[head], c[head]
        pairs = {int(routes.hot[k]): tuple(ef.load(f"{path}/pairs-{routes.hot[k]}")) for k in np.flatnonzero(np.isin(routes.hot, b)).tolist()}
        Trie.build(a, b, c, n, vocab, pairs).save(f"{path}/shard-{shard}")
        trie = Trie.load(f"{path}/shard-{shard}")
        code = np.concatenate([trie.codes(a[i : i + 100_000], b[i : i + 100_000], c[i : i + 100_000]) for i in range(0, len(a), 100_000)])
        per = np.empty(len(o), np.int64)
        per[o] = code[np.cumsum(new) - 1]
        out, at = [], 0
        for k, m in enumerate(size.tolist()):
            d = doc[at : at + m].astype(np.int64)
            total = np.bincount(d, per[at : at + m]).astype(np.int64)
            live = np.flatnonzero(total)
            out.append(_pack(np.diff(live, prepend=0), total[live]))
            at += m
        return pa.table({"origin": pa.array(origins), "blob": pa.array(out, pa.binary()), "docs": pa.array([False] * len(out))})

    def total(t: pa.Table) -> pa.Table:
        is_doc, blobs = t.column("docs").to_pylist(), t.column("blob").to_pylist()
        rows = pa.ipc.open_stream(blobs[is_doc.index(True)]).read_all()
        ids, n = rows.column("id"), np.maximum(rows.column("n").to_numpy() - 1, 0)
        bits = np.zeros(len(n), np.int64)
        for b in (b for b, d in zip(blobs, is_doc) if not d):
            gap, sums = _unpack(b, 2)
            bits[np.cumsum(gap)] += sums
        known = np.asarray(ids.is_valid())
        return pa.table({"doc_id": ids, "n_scored": pa.array(n), "code_sum": pa.array(bits)}).filter(pa.array(known))

    sent = spread(docs).mapInArrow(send, "shard long, origin long, blob binary").repartition(parts(spark, routes.total, 0.5), "shard")
    scored = sent.groupBy("shard").applyInArrow(score, "origin long, blob binary, docs boolean")
    sums = scored.groupBy("origin").applyInArrow(total, "doc_id long, n_scored long, code_sum long")
    bits = F.col("code_sum") / STEP
    mean = F.when(F.col("n_scored") > 0, bits / F.col("n_scored"))
    return sums.select("doc_id", "n_scored", bits.alias("bits"), mean.alias("bits_per_word"), F.pow(F.lit(2.0), mean).alias("perplexity"))
