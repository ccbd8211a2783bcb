"""Batches, groups and folders: results don't depend on how rows are held, and a worker's memory not on their number."""

import random
import shutil
import time
import tracemalloc
from collections import Counter
from random import Random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom import catalogue, partitions
from lexloom.functions import patterns
from lexloom.functions.lattice import Lattice
from lexloom.operators import encode, evaluate, generate
from lexloom.streaming.encode import encode_available


def held_words(n: int) -> list[list[str]]:
    rng = random.Random(5)
    return [[" " + "".join(rng.choice("abcdé\0") for _ in range(rng.randint(1, 30))) for _ in range(20)] for _ in range(n)]


@pytest.mark.parametrize("max_bytes", [3, 24])
def test_groups_count_as_brute_force(max_bytes):
    group, want = generate._Group(max_bytes, frozenset({"ab"}), 1.0), Counter()
    for k, pieces in enumerate([[], [""], *held_words(60)]):
        group.add(pieces, k)
        want.update({t for p in pieces for t in generate.substrings(p, max_bytes)} - {"ab"})
    got = group.counts()
    assert dict(zip(*(c.to_pylist() for c in got.columns))) == want


def test_draws_cost_what_a_sample_has():
    """a sample's draws don't go through the tokens of all samples before it."""
    group = generate._Group(24, frozenset(), 0.1)
    for k, pieces in enumerate(held_words(1000)):
        group.add(pieces, k)
    began = time.time()
    assert group.counts().num_rows
    assert time.time() - began < 30


def test_texts_with_nul_are_counted(spark):
    samples = spark.createDataFrame([("s", 1, "ab\0cd"), ("s", 2, "ab cd"), ("s", 3, "ab")], "source string, sample_id long, text string")
    got = {r[0]: r[1] for r in generate.document_frequency(samples, p=1.0, split="[a-z\0]+").collect()}
    assert got["ab"] == 3 and got["b\0c"] == 1 and "" not in got and got["cd"] == 2


def test_a_batch_is_worked_on_in_slices(monkeypatch):
    """what a batch needs beside its own rows doesn't grow with it."""
    tok, texts = catalogue.byte_tokenizer(), pa.array(["some words and more " * 100, None, ""] * 400)
    assert sum(len(s) for s in partitions.by_bytes(texts)) == len(texts)
    monkeypatch.setattr(partitions, "SLICE", 20_000)
    tracemalloc.start()
    sizes = [n for s in partitions.by_bytes(texts) for n in encode._encoded(tok, s, True)[1].tolist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [2000, 0, 0] * 400
    assert peak < 8_000_000


def test_columns_do_not_depend_on_slices(spark, monkeypatch):
    rows = [("a", "the cat in the hat" * 3), ("a", None), ("b", ""), ("b", "é" * 50), ("b", "\nthe end")]
    df = spark.createDataFrame(rows, "source string, text string").coalesce(1)
    tok = catalogue.word_tokenizer(catalogue.SPECIALS)
    ids = df.select("source", "text", encode.encode(spark, tok, df.text).alias("ids"), encode.encoded_size(spark, tok, df.text).alias("n_ids"))
    for r in ids.collect():
        assert r.ids == (None if r.text is None else tok.encode(r.text))
        assert r.n_ids == (None if r.text is None else len(r.ids))
    assert sorted(evaluate.compression(ids.drop("ids")).collect()) == sorted(evaluate.compression(ids.drop("n_ids")).collect())
    pairs = Counter(p for r in ids.collect() if r.ids for p in zip(r.ids, r.ids[1:]))
    assert {(r.a, r.b): r.freq for r in encode.pair_counts(ids).collect()} == pairs
    cut = pa.array([[1, 2, 1], [], None, [2, 1], [3]], pa.list_(pa.int32()))
    monkeypatch.setattr(partitions, "SLICE", 1)
    summed = encode._summed(map(encode._adjacent, partitions.sliced(cut, pa.compute.list_value_length(cut))))
    assert list(zip(*(c.to_pylist() for c in summed.columns))) == [(1, 2, 1), (2, 1, 2)]


def test_dropped_paths_are_those_of_whole_lattices():
    tok = catalogue.word_tokenizer()
    lattice = Lattice(tok.lattice.values, tok.lattice.scores)
    for k, text in enumerate([b"the other hand in the sand", b"", b"a", b"tion" * 30, b"\xff the"] * 20):
        rng, want = Random(k), []
        for c in lattice.chunks(text):
            want += lattice.viterbi(c, lattice.edges(c, 0.3, rng))[0]
        assert lattice.encode(text, 0.3, Random(k)) == want


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    """documents.parquet may be a folder of files."""
    tok = catalogue.word_tokenizer()
    df = spark.createDataFrame([(i, f"the cat {i}") for i in range(20)], "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    got = encode_available(spark, f"{tmp_path}/folder", "doc_id long, text string", tok, f"{tmp_path}/out", f"{tmp_path}/at", "documents.parquet")
    assert {r.doc_id: r.ids for r in got.collect()} == {i: tok.encode(f"the cat {i}") for i in range(20)}
    shutil.rmtree(tmp_path / "out")


def many_words(n: int) -> list[tuple[str, int, str]]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(words[int(400 * rng.random() ** 3)] for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [("s", k, t + "\0" * (k == 5) + "Ab" * (k % 7 == 0)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("k, max_bytes, listed", [(20, 24, []), (20, 3, []), (100, 24, ["b", "ab", "zz"]), (10_000, 24, []), (0, 24, [])])
def test_first_tokens_are_counted_exactly(spark, monkeypatch, k, max_bytes, listed):
    """F10-F14: without the counts of all others, the first tokens are those of all counts."""
    samples = spark.createDataFrame(many_words(300), "source string, sample_id long, text string")
    kw = {"max_bytes": max_bytes, "split": " ?[A-Za-zé]+", "allow": [" ?[a-zé]+"], "added": listed}
    whole = {r.token: r.freq for r in generate.document_frequency(samples, p=1.0, **kw).collect()}
    got = {r.token: r.freq for r in generate.top_frequency(samples, k, **kw).collect()}
    assert got.items() <= whole.items()
    assert {t for t in whole if len(t.encode()) == 1 or t in listed} <= got.keys()
    for several in (True, False):
        first = lambda counts: sorted((-n, t) for t, n in counts.items() if not several or len(t.encode()) > 1)[:k]  # noqa: B023, E731
        assert first(got) == first(whole)
    assert k not in (20, 100) or max_bytes < 24 or len(got) < len(whole) / 2
    monkeypatch.setattr(generate, "BOUND", 0)
    assert {r.token: r.freq for r in generate.top_frequency(samples, k, **kw).collect()} == whole


def test_workers_hold_few_pieces(monkeypatch):
    """pieces, substrings and cached pieces are given up beyond a number, with the same sums."""
    texts = [t.replace("\0", " ").split() for _, _, t in many_words(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(["\0".join(dict.fromkeys(t)) for t in texts]), pa.nulls(len(texts), pa.list_(pa.string()))], ["joined", "pieces"])
    tokens = ["a", "ab", "abc", "é", "nowhere"]
    weights = pa.RecordBatch.from_arrays([pa.array(["abcdefgh", "abab"]), pa.array([2, 3])], ["token", "n"])
    grams = frozenset(["abcd", "bcde", "cdef", "efgh"])

    def summed(batches):
        out = Counter()
        for b in batches:
            assert generate.WORDS > 1000 or b.num_rows <= generate.WORDS + 50
            for t, n in zip(*(c.to_pylist() for c in b.columns)):
                out[t] += n
        return +out

    runs = [lambda: generate._piece_counts(iter([rows])), lambda: generate._held_counts(tokens, iter([rows])), lambda: generate._gram_counts(iter([weights])), lambda: generate._run_counts(grams, 24, iter([weights]))]
    want = [summed(run()) for run in runs]
    assert want[1] == +Counter({t: sum(any(t in w for w in text) for text in texts) for t in tokens})
    assert want[2]["ab"] == 8 and want[2]["abcd"] == 2 and want[3] == {"abcde": 2, "bcdef": 2, "abcdef": 2}
    monkeypatch.setattr(generate, "WORDS", 10)
    assert [summed(run()) for run in runs] == want


def test_seeds_are_counted_once(spark):
    """F10-F14: the largest frequency and the first tokens come from one pass over the counts."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    freq = spark.createDataFrame([("a", 9), ("ab", 7), ("abc", 5), ("x", 1)], "token string, freq long").coalesce(1)
    vocab = generate.seed_vocabulary(freq.mapInArrow(counted, "token string, freq long"), 257, ["abc"]).collect()
    assert passes.value == 1
    assert {bytes(r.value): r.keep for r in vocab if len(r.value) > 1} == {b"ab": False, b"abc": True} and len(vocab) == 257


def test_reports_count_the_first_tokens_only(spark, monkeypatch):
    """buckets of the first tokens don't need the counts of all."""
    monkeypatch.setattr(generate, "document_frequency", None)
    assert catalogue.frequency_buckets(spark, "/root/testdata/sf0.001").count() == 50


def test_loaded_sources_have_empty_texts(spark, tmp_path):
    """as in its SQL, null and empty texts are among all documents, and count for no half."""
    rows = [(1, "a\nb"), (2, ""), (3, None), (4, "c\r\nd"), (5, "e"), (6, "f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(duck.execute(catalogue.ORACLES["load_sources"]).fetchall())
    assert Counter(map(tuple, catalogue.load_sources(spark, str(tmp_path)).collect())) == want


ODD = ["", "the cat  Sat\non", "a\0b é ß ﬁ 中文字 𝒳𝒳a", "it's 'X' \"Yes\" <b> x12 1234567", "A" * 50 + " b" * 20, "\r\n\t  .a..b"]


@pytest.mark.parametrize("split", ["any-char", "space-word", "space-english-word", "space-french-word", "chinese-word", "short-number", "word-wrapped-in-quotes", " ?[a-c]{2,3}|[^a-z]+", "𝒳|(?:ﬁ?.)"])
def test_plain_patterns_are_found_alike(spark, split):
    """where Python cuts the texts, it finds what Java finds."""
    pieces = F.regexp_extract_all("text", F.lit(patterns.mine_regex([split])), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", pieces.alias("p")).collect()
    cut = generate._finder(split)
    assert [cut(r.text) for r in rows] == [r.p for r in rows]
    assert not any(map(generate._finder, [r"\w+", "(a)b", "(?:ab)+", "[a&&b]", "[[:punct:]]", "^a", "a+?", "(?i)a", "a{,2}", "a{2}{3}", "[a-c-e]"]))


def test_first_tokens_of_plain_patterns_are_cut_in_python(spark, monkeypatch):
    """neither Java's matches nor an automaton for a handful of listed tokens; broken UTF-8 is read as Java reads it."""
    samples = spark.createDataFrame([("s", k, t) for k, t in enumerate(["the cat", "the hat", "thé tion"])], "source string, sample_id long, text string")
    samples = samples.unionAll(samples.select("source", "sample_id", F.expr("cast(concat(encode(text, 'utf-8'), x'ff61') as string)")))
    kw = {"split": "space-word", "added": ["tion"], "suggested": ["t c"]}
    whole = {r.token: r.freq for r in generate.document_frequency(samples, p=1.0, split="space-word").collect()}
    monkeypatch.setattr(generate, "_pieces", None)
    got = {r.token: r.freq for r in generate.top_frequency(samples, 3, **kw).collect()}
    assert got.pop("tion") == 3 and got.pop("t c") == 1
    assert got.items() <= whole.items() and got["a"] == 5 and got["the"] == 4


def test_cached_pieces_are_bounded_by_bytes(monkeypatch):
    """the numbers of the tokens in the cached pieces are given up beyond so many bytes; they are those of a search by brute force."""
    texts = [t.replace("\0", " ") for _, _, t in many_words(300)]
    tokens = ["a", "ab", "bca", "abcd", "é", "éa", "b", "cd", "nowhere"]
    found = generate._Found(tokens)
    for piece in {p for t in texts for p in t.split()} | {"", "aaaa", "nowhereabcdé"}:
        want = sorted(i for i, t in enumerate(tokens) for at in range(len(piece)) if piece.startswith(t, at))
        assert sorted(memoryview(found[piece]).cast("i")) == want
    assert found.held == sum(map(len, found.values())) > 1000
    most, rows = [], pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    class Watched(generate._Found):
        def __missing__(self, piece):
            ids = super().__missing__(piece)
            most.append(sum(map(len, self.values())))
            return ids

    monkeypatch.setattr(generate, "_Found", Watched)
    want = [b.to_pydict() for b in generate._held_counts(tokens, iter([rows]), str.split)]
    assert max(most) > 2000
    most.clear()
    monkeypatch.setattr(generate, "CACHED", 200)
    assert [b.to_pydict() for b in generate._held_counts(tokens, iter([rows]), str.split)] == want
    assert max(most) < 2000
