"""Encoding and decoding columns, and the counts that follow from them.

The vocabulary goes to the workers as a broadcast of its JSON form, whose size
depends on the vocabulary alone; above ``BROADCAST_BYTES`` it is refused rather
than sent.  Each worker builds its prefix dictionary once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.tokenizer import Tokenizer
from lexloom.partitions import by_bytes, sliced

BROADCAST_BYTES = 256_000_000
HELD = 500_000
_built: dict[int, Tokenizer] = {}


class Shared:
    """A tokenizer on every worker."""

    def __init__(self, spark: SparkSession, tokenizer: Tokenizer) -> None:
        text = tokenizer.to_string()
        if len(text) > BROADCAST_BYTES:
            raise ValueError(f"a vocabulary of {len(text)} bytes is too large to broadcast")
        self.held = spark.sparkContext.broadcast(text)
        self.key = hash(text)

    def get(self) -> Tokenizer:
        if self.key not in _built:
            if len(_built) > 3:
                _built.clear()
            _built[self.key] = Tokenizer.from_str(self.held.value)
        return _built[self.key]


def encode(spark: SparkSession, tokenizer: Tokenizer, text: Column, dropout: float = 0.0, specials: bool = True, seed: int = 0) -> Column:
    """array<int> of ids; null for null.  With dropout each text draws from a generator of its own (seed and text)."""
    shared = Shared(spark, tokenizer)

    @F.arrow_udf("array<int>")
    def ids(s: pa.Array) -> pa.Array:
        tok = shared.get()
        run = tok.encode if specials else tok.encode_ordinary
        each = []
        for some in by_bytes(s):
            if dropout > 0:
                each.append(pa.array([None if t is None else run(t, dropout, Random(f"{seed}:{t}")) for t in some.to_pylist()], pa.list_(pa.int32())))
                continue
            flat, n = _encoded(tok, some, specials)
            each.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat.astype(np.int32)), mask=some.is_null()))
        return pa.concat_arrays(each) if each else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def encoded_size(spark: SparkSession, tokenizer: Tokenizer, text: Column, specials: bool = True) -> Column:
    """How many ids ``encode`` gives, without handing them on."""
    shared = Shared(spark, tokenizer)

    @F.arrow_udf("long")
    def size(s: pa.Array) -> pa.Array:
        each = [pa.array(_encoded(shared.get(), some, specials)[1].astype(np.int64), mask=np.asarray(some.is_null())) for some in by_bytes(s)]
        return pa.concat_arrays(each) if each else pa.array([], pa.int64())

    return size(text)


def _encoded(tok: Tokenizer, s: pa.Array, specials: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts in a row, how many each has)."""
    # every piece between special tokens is one text; all pieces are encoded together
    texts, owner, fixed = [], [], []
    for k, t in enumerate(s.to_pylist()):
        for piece, special in (tok.split(t or "") if specials else [(t or "", False)]):
            fixed.append(tok.special_token_to_id(piece) if special else -1)
            texts.append(b"" if special else tok.processed(piece).encode(errors="surrogatepass"))
            owner.append(k)
    flat, size = tok.lattice.encode_all(texts)
    fixed, owner = np.array(fixed, np.int32), np.array(owner, np.int64)
    marks = np.flatnonzero(fixed >= 0)
    flat = np.insert(flat, np.cumsum(size)[marks], fixed[marks])
    size[marks] = 1
    return flat, np.bincount(owner, size, len(s)).astype(np.int64)


def decode(spark: SparkSession, tokenizer: Tokenizer, ids: Column, include_special_tokens: bool = True) -> Column:
    """The text of array<int>; an id out of range is an error."""
    shared = Shared(spark, tokenizer)

    def decoded(tok: Tokenizer, s: pa.Array) -> pa.Array:
        flat = np.asarray(s.flatten()).astype(np.int64)
        if include_special_tokens and (not len(flat) or (flat.min() >= 0 and flat.max() < tok.vocab_size())):
            value = pa.array([t.value for t in tok.vocab] + [t.encode() for t in tok.special_tokens()], pa.large_binary()).take(pa.array(flat))
            at = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
            ends = np.append(0, np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(s), 0))))
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at[ends].tobytes()), value.buffers()[2]])
            try:  # whole texts of valid UTF-8 need no repair
                return pa.compute.if_else(s.is_valid(), joined.cast(pa.large_string()), None).cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([None if x is None else tok.decode(x, include_special_tokens) for x in s.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def text(s: pa.Array) -> pa.Array:
        each = [decoded(shared.get(), some) for some in sliced(s, pa.compute.list_value_length(s))]
        return pa.concat_arrays(each) if each else pa.array([], pa.string())

    return text(ids)


def split_specials(spark: SparkSession, tokenizer: Tokenizer, text: Column) -> Column:
    """array<struct<text, is_special>>."""
    shared = Shared(spark, tokenizer)

    @F.pandas_udf("array<struct<text:string,is_special:boolean>>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"text": a, "is_special": b} for a, b in shared.get().split(t)])

    return pieces(text)


def chunk_counts(samples: DataFrame, shared: Shared, most_bytes: int = 0) -> DataFrame:
    """chunk, n: the pieces into which every segmentation must fall, over the whole corpus.

    Texts of over ``most_bytes`` bytes (if given) are first cut to that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = shared.get().lattice.chunks, Counter()
        for rows in batches:
            for t in (t for some in by_bytes(rows.column(0)) for t in some.to_pylist()):
                raw = t.encode(errors="surrogatepass")
                for a in range(0, len(raw), most_bytes or len(raw) or 1):
                    held.update(cut(raw[a : a + most_bytes] if most_bytes else raw))
                if len(held) > HELD:
                    yield _pairs(held)
                    held = Counter()
        if held:
            yield _pairs(held)

    texts = samples.select("text").where("text is not null and text <> ''")
    return texts.mapInArrow(run, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["chunk", "n"])


def weighted_by_chunk(chunks: DataFrame, shared: Shared, fn: Callable, kind: str) -> DataFrame:
    """id, amount: fn(lattice, chunk) -> {id: amount} of each distinct chunk, times its n, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = shared.get().lattice, {}
        for rows in batches:
            for chunk, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for t, x in fn(lattice, chunk).items():
                    total[t] = total.get(t, 0) + x * n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64() if kind == "double" else pa.int64())], ["id", "amount"])

    return chunks.select("chunk", "n").mapInArrow(run, f"id int, amount {kind}").groupBy("id").agg(F.sum("amount").alias("amount"))


def token_frequency(samples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """id, freq of the best segmentation (no special tokens); each distinct chunk is encoded once in the cluster."""
    shared = Shared(samples.sparkSession, tokenizer)
    found = weighted_by_chunk(chunk_counts(samples, shared), shared, lambda lattice, c: Counter(lattice.viterbi(c)[0]), "long")
    return found.select("id", F.col("amount").alias("freq"))


def _adjacent(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a << 32 | b, number) of the adjacent ids within the lists."""
    flat = np.asarray(col.flatten()).astype(np.int64)
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)))
    inside = np.ones(max(0, len(flat) - 1), bool)
    inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    return np.unique((flat[:-1] << 32 | flat[1:])[inside], return_counts=True)


def _summed(each: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """a, b, n from (a << 32 | b, number) of several slices."""
    keys, n = zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *each)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, np.concatenate(n))
    return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["a", "b", "n"])


def pair_counts(encoded: DataFrame) -> DataFrame:
    """a, b, freq of adjacent ids within a sample, from a column ids; a task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = rows.column(0)
            yield _summed(map(_adjacent, sliced(col, pa.compute.list_value_length(col))))

    return encoded.select("ids").where("ids is not null").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("freq"))


def sample_pair_counts(samples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """a, b, freq of adjacent ids within a sample (no special tokens).

    A task encodes each distinct chunk once; pairs inside it count as often as it
    occurs, and where chunks meet, the last and first of their ids are a pair.
    """
    shared = Shared(samples.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            tok = shared.get()
            yield _summed(tok.lattice.pairs([tok.processed(t).encode(errors="surrogatepass") for t in some.to_pylist()]) for some in by_bytes(rows.column(0)))

    texts = samples.select("text").where("text is not null and text <> ''")
    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("freq"))
