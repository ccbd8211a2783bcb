"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; in each, one gated
recurrent network reads forwards and one backwards, and a linear layer on both
states gives a distribution over languages at every byte.  A document's
probabilities are the mean over all its bytes.  The network is written and
trained in numpy: cross-entropy at every position, gradients by
backpropagation through time, Adam.

The training sample is bounded by ``TRAIN_DOCS`` labelled documents, an equal
number of each language, those with the smallest hash of doc_id; they are read
whole, in windows of ``WINDOW`` bytes.  The scoring reads every byte of every
document, in windows of ``SCORED``.

Defined cases: a null or empty text has a null language, probability and share; with no
labelled document there is no model and every language is null; with one
language every text has it; rows with null or repeated ids are labelled each
for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._spark import over_texts

WINDOW, SCORED, HIDDEN, TRAIN_DOCS, EPOCHS, BATCH, PAD = 128, 512, 8, 600, 2, 96, 256


def windows(raw: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by time and window, padded; length of each window; its text's number)."""
    n = np.array([len(r) for r in raw], np.int64)
    count = -(-n // size)
    doc = np.repeat(np.arange(len(raw)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size, n[doc] - nth * size)
    at = (np.cumsum(n) - n)[doc] + nth * size
    flat = np.frombuffer(b"".join(raw), np.uint8)
    t = np.arange(size)[:, None]
    live = t < length
    x = np.full((size, len(doc)), PAD, np.int16)
    x[live] = flat[(at + t)[live]]
    return x, length, doc


def _flip(length: np.ndarray, size: int) -> np.ndarray:
    """Row of each step when a window is read from its last byte; padding stays behind."""
    t = np.arange(size)[:, None]
    return np.where(t < length, length - 1 - t, t)


class Network:
    """Parameters: for each direction the input table (3H x 257), recurrent weights (3H x H) and the candidate's bias; the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["e" + d] = rng.normal(0, 0.3, (3 * hidden, PAD + 1)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros((hidden, 1), np.float32)
        self.p["w"] = rng.normal(0, 0.3, (n_labels, 2 * hidden)).astype(np.float32)
        self.p["b"] = np.zeros((n_labels, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, H, B) for inputs (T, B), and what backpropagation needs."""
        e, u, c, h = self.p["e" + d], self.p["u" + d], self.p["c" + d], self.h
        out, held = np.empty((len(x), h, x.shape[1]), np.float32), []
        s = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x)):
            a, g = e[:, x[t]], u @ s
            zr = a[: 2 * h] + g[: 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            gn = g[2 * h :] + c
            n = np.tanh(a[2 * h :] + zr[h:] * gn)
            if keep:
                held.append((s, zr, gn, n))
            s = n + zr[:h] * (s - n)
            out[t] = s
        return out, held

    def logits(self, x: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple:
        flip = _flip(length, len(x))
        back = np.take_along_axis(x, flip, 0)
        hf, kf = self.states(x, "f", keep)
        hb, kb = self.states(back, "b", keep)
        hb = np.take_along_axis(hb, flip[:, None, :], 0)
        s = np.concatenate([hf, hb], 1)
        return np.einsum("lk,tkb->tlb", self.p["w"], s, optimize=True) + self.p["b"], s, flip, back, kf, kb

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(T, labels, B); past a window's length all zero."""
        z = self.logits(x, length)[0]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z *= (np.arange(len(x))[:, None] < length)[:, None, :]
        return z

    def _back(self, x: np.ndarray, d: str, held: list, ds: np.ndarray, grad: dict) -> None:
        h, u = self.h, self.p["u" + d]
        carry = np.zeros_like(ds[0])
        da_all = np.empty((len(x), 3 * h, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            s, zr, gn, n = held[t]
            z, r = zr[:h], zr[h:]
            dh = ds[t] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (s - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r])
            grad["u" + d] += dg @ s.T
            grad["c" + d] += dg[2 * h :].sum(1, keepdims=True)
            carry = dh * z + u.T @ dg
            da_all[t] = np.concatenate([dz, dr, dn])
        flat = x.ravel()
        for k in range(3 * h):
            grad["e" + d][k] += np.bincount(flat, da_all[:, k].ravel(), PAD + 1).astype(np.float32)

    def gradient(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """(loss, gradients) of the weighted mean cross-entropy over all positions."""
        z, s, flip, back, kf, kb = self.logits(x, length, True)
        live = (np.arange(len(x))[:, None] < length) * weight
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        total = live.sum()
        true = p[:, y, np.arange(len(y))]
        loss = float(-(np.log(true + 1e-9) * live).sum() / total)
        p[:, y, np.arange(len(y))] -= 1
        p *= (live / total)[:, None, :]
        p = p.astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["w"] += np.einsum("tlb,tkb->lk", p, s, optimize=True)
        grad["b"] += p.sum((0, 2))[:, None]
        ds = np.einsum("lk,tlb->tkb", self.p["w"], p, optimize=True)
        self._back(x, "f", kf, ds[:, : self.h], grad)
        self._back(back, "b", kb, np.take_along_axis(ds[:, self.h :], flip[:, None, :], 0), grad)
        return loss, grad

    def train(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> list[float]:
        rng = np.random.default_rng(seed)
        share = np.bincount(y) / len(y)
        weight = (1 / np.maximum(share, 1e-9))[y] / len(share)  # each language weighs the same
        m, v, step, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                k = order[a : a + batch]
                loss, grad = self.gradient(x[:, k], length[k], y[k], weight[k])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                now = rate * (1 - (step - 1) / total)
                for name, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses


def sample(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """The training sample's (text, lang): a documented bound on labelled rows, whatever the corpus's size.

    The rows are chosen by hashes alone; only texts of chosen rows leave their tasks.
    """
    known = docs.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    keys = known.groupBy("lang", "doc_id", "h").agg(F.lit(1).alias("one"))
    n_lang = keys.select("lang").distinct().count()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    top = keys.withColumn("k", F.row_number().over(order)).where(F.col("k") <= -(-n_docs // max(n_lang, 1))).select("lang", "doc_id", "h").collect()
    chosen = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in top], "of_lang string, of_doc long, of_text long"))
    met = known.join(chosen, (F.col("lang") == F.col("of_lang")) & F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_text")))
    rows = met.groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "h", "lang").collect()
    return [(r["text"], r["lang"]) for r in rows]


def trained(pairs: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS) -> tuple[list[str], Network] | None:
    """(languages, network) from labelled texts, all their bytes."""
    names = sorted({lang for _, lang in pairs})
    if not names:
        return None
    net = Network(len(names), hidden)
    if len(names) > 1:
        x, length, doc = windows([text.encode("utf-8", "surrogatepass") for text, _ in pairs])
        net.train(x, length, np.array([names.index(lang) for _, lang in pairs])[doc], epochs)
    return names, net


def pooled(net: Network, texts: list[str | None], block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean probabilities, share of positions labelled as the document, bytes) of every text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    x, length, doc = windows(raw, min(SCORED, max(map(len, raw), default=1) or 1))
    n_labels = len(net.p["b"])
    total, votes = np.zeros((len(raw), n_labels)), np.zeros((len(raw), n_labels))
    for a in range(0, len(doc), block):
        p = net.probabilities(x[:, a : a + block], length[a : a + block])
        d = doc[a : a + block]
        np.add.at(total, d, p.sum(0, dtype=np.float64).T)
        live = np.arange(len(x))[:, None] < length[a : a + block]
        best = p.argmax(1)
        for k in range(n_labels):
            np.add.at(votes[:, k], d, ((best == k) & live).sum(0))
    n = np.array([len(r) for r in raw], np.int64)
    mean = total / np.maximum(n, 1)[:, None]
    top = mean.argmax(1)
    return mean, votes[np.arange(len(raw)), top] / np.maximum(n, 1), n


def identified(docs: DataFrame, train_docs: int = TRAIN_DOCS, model: tuple[list[str], Network] | None = None) -> DataFrame:
    """(doc_id, language, probability, position_share, n_bytes) of every document."""
    model = model or trained(sample(docs, train_docs))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(rows: pa.RecordBatch, texts: list) -> dict:
        if held.value is None:
            none = [None] * len(texts)
            return {"doc_id": rows.column(0), "language": none, "probability": none, "position_share": none, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]}
        names, net = held.value
        p, share, n = pooled(net, texts)
        top, empty = p.argmax(1), n == 0
        return {"doc_id": rows.column(0), "language": [None if e else names[k] for k, e in zip(top, empty)], "probability": pa.array(p.max(1), mask=empty), "position_share": pa.array(share, mask=empty), "n_bytes": n}

    return over_texts(docs.select("doc_id", "text"), "text", "doc_id long, language string, probability double, position_share double, n_bytes long", fn)
