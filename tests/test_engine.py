"""Operators on small fixtures, against brute force."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions import columns
from lexloom.functions.lattice import digamma
from lexloom.functions.patterns import NAMED, allow_regex
from lexloom.functions.tokenizer import Token, Tokenizer
from lexloom.operators import curate, evaluate, generate, mine, prune, vocabulary
from lexloom.operators.encode import decode, encode, pair_counts, token_frequency
from lexloom.plans import train
from lexloom.sources import corpus
from lexloom.streaming.encode import encode_available

CODE = ["std::string a; std::vector b;", "std::string c = std::string();", "use std::vector;", "map string goodbye vec"]
FULL = {
    "any-char": (["好", "A"], ["123"]), "space-lowercase-word": ([" hi", "hi"], ["Hi", " HI"]), "capitalized-word": (["Hello"], ["HeLlO"]), "space-english-word": (["don't", " You'll"], ["ABC'DEF"]),
    "space-french-word": (["Été"], ["مرحبا"]), "chinese-word": (["你好"], ["مرحبا"]), "english-contraction": (["'re", "'ll", "'t"], ["'x"]), "short-decimal-number": (["1.1", "123.4"], ["123.456", "1000.0"]),
    "indent": ([" ", "   ", "\t\t"], ["\t "]), "newline-indent": (["\n  ", "\n\t\t"], ["\n\t "]), "whitespace": ([" \n\t", " ", "　"], ["x"]), "space-punct-space": ([" # ", " ( "], [" != "]),
    "few-repeated-punct": (["###", "()"], ["#####"]), "punct-newline": ([";\n"], [";\n\n"]), "repeated-punct-newline-indent": ([");\n\t\t"], [")\n"]), "space-operator-space": ([" + ", " !==", ">>>", "()"], ["a"]), "word-wrapped-in-quotes": (["'abc'", '"V"'], ["abc"]),
}


def samples(spark, texts, source="s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source string, sample_id long, text string")


def test_patterns_match_whole_strings(spark):
    rows = [(n, allow_regex([n]), t, ok) for n, (good, bad) in FULL.items() for t, ok in [*((g, True) for g in good), *((b, False) for b in bad)]]
    got = spark.createDataFrame(rows, "name string, re string, t string, ok boolean").where("(t rlike re) <> ok").collect()
    assert not got and set(FULL) <= set(NAMED)


def test_carriage_return_counts_as_a_character(spark):
    got = mine.idiom_counts(samples(spark, ["a\rb\n"]), ["any-char"]).collect()
    assert {r["token"] for r in got} == {"a", "\r", "b"}
    assert not samples(spark, ["ab\n"]).where(F.col("text").rlike(allow_regex(["word"]))).count()


def test_mine(spark):
    got = [tuple(r) for r in mine.mine(samples(spark, CODE), [r"std::\w+"], 2).collect()]
    assert got == [("std::string", 3), ("std::vector", 2)]
    assert mine.mine(samples(spark, []), ["word"], 5).count() == 0
    first = [tuple(r) for r in mine.mine(samples(spark, ["ab 12 ab"]), ["word", "short-number"], 9).collect()]
    assert first == [("ab", 2), ("12", 1)]


def brute_frequency(texts, max_bytes):
    out = Counter()
    for t in texts:
        out.update({t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1) if len(t[i:j].encode()) <= max_bytes})
    return out


def test_document_frequency_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abé好 ", k=rng.randint(1, 40))) for _ in range(30)] + [None, "", "aa"]
    got = {r[0]: r[1] for r in generate.document_frequency(samples(spark, texts), max_bytes=5, p=1.0).collect()}
    assert got == brute_frequency([t for t in texts if t], 5)
    monkeypatch.setattr(generate, "LONG", 10)  # the way for long samples
    assert {r[0]: r[1] for r in generate.document_frequency(samples(spark, texts), max_bytes=5, p=1.0).collect()} == got


@pytest.mark.parametrize("step", [1, 3, 7, 100])
def test_windows_of_a_long_piece_give_every_place_once(step):
    text = "abé好x" * 9
    assert Counter(s for w in generate._windows(text, 6, step) for s in w) == Counter(generate.substrings(text, 6))


def test_sampling_draws_each_occurrence(spark):
    texts = [f"{i} ab ab ab" for i in range(3000)]
    got = {r[0]: r[1] for r in generate.document_frequency(samples(spark, texts), split="lowercase-word", p=0.2).collect()}
    assert abs(got["ab"] / 3000 - (1 - 0.8**3)) < 0.05


def test_generate_with_lists(spark):
    tok = train.generate(samples(spark, CODE), 266, added=["goodbye", "vec"], suggested=["string", "map"], p=1.0, max_bytes=6, allow=["space-lowercase-word"])
    values = [t.value for t in tok.vocab]
    assert len(values) == 266 and {b"string", b"goodbye", b"vec", b"map"} <= set(values) and b"\xff" not in values
    keep = {t.value: t.keep for t in tok.vocab}
    assert keep[b"vec"] and keep[b"a"] and not keep[b"string"]
    assert sum(math.exp(t.score) for t in tok.vocab) == pytest.approx(1)
    freq = {r[0]: r[1] for r in generate.listed_frequency(samples(spark, CODE), ["vec"], ["vec", "zzz"]).collect()}
    assert freq == {"vec": 2 + 3, "zzz": 1}


def test_filter(spark):
    toks = [Token(b"a", -1, True), Token(b"b", -2), Token(b"c", -14, True), Token(b"d", -15), Token(b"e", -15), Token(b"f", -13)]
    vocab = corpus.vocab_frame(spark, toks)
    left = lambda **kw: [t.value for t in corpus.vocab_list(vocabulary.filtered(vocab, **kw))]
    assert left(size=2) == [b"a", b"b", b"f", b"c", b"d", b"e"]  # no least score: nothing goes
    assert left(size=2, min_score=-13.0) == [b"a", b"b", b"c"]  # at most the score, and kept ones stay
    assert left(size=2, min_score=-13.0, force=True) == [b"a", b"b"]
    assert left(size=5, min_score=-13.0) == [b"a", b"b", b"f", b"c", b"d"]


def test_lookups(spark):
    vocab = corpus.vocab_frame(spark, [Token(b"a", -1), Token(b"ab", -1), Token(b"a", -2)])
    texts = spark.createDataFrame([("abc",), ("x",), ("",), (None,)], "token string")
    assert sorted(tuple(r) for r in vocabulary.prefix_search(texts, vocab, "token").collect()) == [("abc", 1, 2), ("abc", 2, 1)]
    assert {r["token"]: r["id"] for r in vocabulary.token_ids(spark.createDataFrame([("a",), ("z",)], "token string"), vocab).collect()} == {"a": 2, "z": None}


BYTES = [Token(bytes([i]), -9.0, True) for i in range(256)]
TOK = Tokenizer(BYTES + [Token(w.encode(), -5.0 - k / 10) for k, w in enumerate(["th", "he", "the", " t", "in", "ing", "é", " the"])], ["crlf"], ["<s>"])
TEXTS = ["the thing in the ring", "thé héé\r\nin", "<s>the", "x", "the thing in the ring"]


def test_encode_decode_and_counts(spark):
    df = samples(spark, [*TEXTS, "", None]).withColumn("ids", encode(spark, TOK, F.col("text"))).withColumn("back", decode(spark, TOK, F.col("ids")))
    for r in df.collect():
        assert r["ids"] == (None if r["text"] is None else TOK.encode(r["text"]))
        assert r["back"] == (None if r["text"] is None else r["text"].replace("\r\n", "\n"))
    pairs = Counter(p for t in TEXTS for p in zip(TOK.encode(t), TOK.encode(t)[1:]))
    assert {(r["a"], r["b"]): r["freq"] for r in pair_counts(df).collect()} == pairs
    freq = Counter(i for t in TEXTS for i in TOK.lattice.encode(t.encode()))
    assert {r["id"]: r["freq"] for r in token_frequency(samples(spark, TEXTS), TOK).collect()} == freq


def test_expected_counts(spark):
    want = {}
    for t in TEXTS:
        for i, x in TOK.lattice.expected(t.encode())[0].items():
            want[i] = want.get(i, 0) + x
    got = {r["id"]: r["expected"] for r in prune.expected_counts(samples(spark, TEXTS), TOK).collect()}
    assert got == pytest.approx(want)
    dropped = prune.expected_counts(samples(spark, TEXTS), TOK, dropout=1.0).collect()
    assert all(r["id"] < 256 for r in dropped) and sum(r["expected"] for r in dropped) == pytest.approx(sum(len(t.encode()) for t in TEXTS))
    cut = prune.expected_counts(samples(spark, TEXTS), TOK, snippet=4).collect()
    assert sum(r["expected"] * len(TOK.vocab[r["id"]].value) for r in cut) == pytest.approx(sum(len(t.encode()) for t in TEXTS))


def test_m_step(spark):
    vocab = corpus.vocab_frame(spark, [Token(b"a", -1, True), Token(b"b", -1), Token(b"c", -1), Token(b"d", -1)])
    expected = spark.createDataFrame([(1, 0.4), (2, 3.5), (3, 12.0)], "id int, expected double")
    got = corpus.vocab_list(prune.reestimated(vocab, expected))
    assert [t.value for t in got] == [b"a", b"c", b"d"]
    assert [t.score for t in got] == pytest.approx([digamma(x) - digamma(16.0) for x in (0.5, 3.5, 12.0)])
    xs = [0.5, 0.9, 1.0, 3.3, 6.99, 7.0, 7.01, 50.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", columns.digamma(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == pytest.approx({x: digamma(x) for x in xs})


def test_losses_and_rules(spark):
    toks = [Token(b"a", -2, True), Token(b"b", -2), Token(b"c", -2), Token(b"ab", -3), Token(b"bc", -9), Token(b"abc", -4), Token(b"ca", -3.5)]
    tok, n = Tokenizer(toks), 3
    texts = ["abcab", "aab", "abc"]
    vocab = corpus.vocab_frame(spark, toks)
    got = {r["value"]: r for r in prune.losses(vocab, prune.alternatives(vocab, tok), token_frequency(samples(spark, texts), tok), n).collect()}
    freq = Counter(i for t in texts for i in tok.encode(t))
    s = sum(freq.values())
    assert got[b"a"]["rule"] == "stay" and got[b"b"]["rule"] == "stay"  # kept; nothing else spells it
    assert got[b"bc"]["rule"] == "drop"  # never used, and its parts are better
    assert got[b"ca"]["rule"] == "drop"  # never used, though best for itself
    for i in (3, 5):
        f, alts = freq[i], tok.lattice.alternative(i)[1]
        grown = math.log(s + f * (len(toks) - 1))
        want = f / n * (math.log(f) - math.log(s) - sum(math.log(freq[a] + f) - grown for a in alts))
        assert got[toks[i].value]["rule"] == "candidate" and got[toks[i].value]["loss"] == pytest.approx(want)


def test_prune_and_merge_loops(spark):
    texts = ["the thing in the ring", "then the king", "in the thing"] * 4
    tok = train.prune(samples(spark, texts), TOK, 258, dropout=0.0)
    assert len(tok.vocab) == 258 and tok.special_tokens() == ["<s>"] and sum(t.keep for t in tok.vocab) == 256
    noisy = train.prune(samples(spark, texts), TOK, 258, dropout=0.1, sub_iterations=2)
    assert len(noisy.vocab) <= 258 and all(tok.decode(tok.encode(t)) == t for t in texts)
    more = train.merge(samples(spark, texts), Tokenizer(BYTES), ["space-lowercase-word"], merges=5, step=2)
    pairs = Counter(p for t in texts for p in zip(t.encode(), t.encode()[1:]) if bytes(p).decode().strip(" ").isalpha() and not bytes(p).endswith(b" "))
    best = sorted(pairs, key=lambda p: (-pairs[p], p))[:2]
    assert [t.value for t in more.vocab[256:258]] == [bytes(p) for p in best] and len(more.vocab) == 261
    assert more.vocab[256].score == pytest.approx(-18 * 0.9)
    none = train.merge(samples(spark, ["a"]), Tokenizer(BYTES), ["word"], merges=3)
    assert len(none.vocab) == 256  # no pair: it ends


def test_reports(spark):
    df = samples(spark, ["aaa", "ba"], "x").unionAll(samples(spark, ["cc"], "y"))
    found = {(r["source"], r["is_total"]): (r["occurrences"], r["samples_hit"], r["percent"]) for r in evaluate.find(df, "a").collect()}
    assert found == {("x", 0): (4, 2, 100.0), (None, 1): (4, 2, 66.67)}
    by = evaluate.compression(df.withColumn("ids", encode(spark, Tokenizer([*BYTES, Token(b"aa", -1)]), F.col("text"))))
    assert {r["source"]: tuple(r)[1:] for r in by.collect()} == {"x": (4, 5, 1.25), "y": (2, 2, 1.0)}
    report = [tuple(r) for r in evaluate.compression_report(by, {"both": ["x", "y"], "no": ["x", "z"]}).collect()]
    assert [r[:2] for r in report] == [("source", "x"), ("source", "y"), ("average", "all"), ("average", "both")] and report[2][4] == 1.17
    freq = spark.createDataFrame([(i, 10 - i) for i in range(7)], "id int, freq long")
    assert [tuple(r) for r in evaluate.frequency_buckets(freq, 7, 3).orderBy("bucket").collect()] == [(0, 19), (1, 15), (2, 11)]


def test_curation(spark):
    good = "\n".join(["a line of ordinary code here"] * 3)
    rows = [(1, "c", good), (2, "c", "x"), (3, "json", good * 200), (4, "c", "a" * 1200), (5, "c", "(((--))) [[]] ;;" * 4), (6, "c", "12345678901 ab\n" * 3), (7, "c", "\n".join(["QUJD" * 20] * 5)), (8, "c", "привет мир abcde\n" * 3), (9, "c", None), (10, "c", "")]
    got = {r["doc_id"]: r["reason"] for r in curate.judged(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got == {1: None, 2: "size", 3: "lines", 4: "line length", 5: "alphanumeric", 6: "digits", 7: "encoded", 8: "script", 9: "size", 10: "size"}
    split = {r["sample_id"]: r["split"] for r in curate.quota_split(samples(spark, ["aaaa"] * 6), 8, 10).collect()}
    assert split == {0: "test", 1: "test", 2: "train", 3: "train"}
    texts = ["".join(random.Random(k).choices("abcdef", k=700)) for k in range(9)] + ["short"]
    made = [r["text"] for r in curate.infilling(samples(spark, texts)).collect()]
    assert len(made) == 3 and sum(m.count("\x7f") for m in made) == 9 * 9
    assert all(any(c in t for t in texts) for m in made for c in m.split("\x7f")[1:9])


def test_sources(spark, tmp_path):
    raw = tmp_path / "a.bin"
    raw.write_bytes("one\r\nx\0\0twö\0three\0four".encode())
    got = corpus.load(spark, [f"a:{raw}", f"b:{raw}:0.5"], ["crlf"]).orderBy("source", "sample_id").collect()
    assert [(r["source"], r["text"]) for r in got] == [("a", "one\nx"), ("a", "twö"), ("a", "three"), ("a", "four"), ("b", "one\nx"), ("b", "twö")]
    raw.write_bytes(b"ok\0\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        corpus.read_samples(spark, str(raw), "a").collect()
    for bad in ("a", "a:b:c:d", "a:b:2"):
        with pytest.raises(ValueError):
            corpus.parse_spec(bad)
    out = str(tmp_path / "out")
    corpus.write_samples(samples(spark, ["p\nq", "r", ""]), out)
    assert sorted(r["text"] for r in corpus.read_samples(spark, out, "o").collect()) == ["p\nq", "r"]
    totals = corpus.totals(samples(spark, ["ab", "é"])).first()
    assert (totals["samples"], totals["bytes"], totals["chars"]) == (2, 4, 3)
    (tmp_path / "p.regex").write_text(" ab\r\n+ \n")
    assert corpus.read_pattern(str(tmp_path / "p.regex")) == "ab+"
    corpus.write_tokens(["a", "b"], str(tmp_path / "t.json"))
    assert corpus.read_tokens([str(tmp_path / "t.json")] * 2) == ["a", "b", "a", "b"]
    (tmp_path / "bad.json").write_text(json.dumps({"a": 1}))
    with pytest.raises(ValueError):
        corpus.read_tokens([str(tmp_path / "bad.json")])


def test_stream(spark, tmp_path):
    a, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    schema = "source string, sample_id long, text string"
    samples(spark, TEXTS[:2]).write.mode("append").parquet(a)
    assert encode_available(spark, a, schema, TOK, out, at).count() == 2
    samples(spark, TEXTS[2:]).write.mode("append").parquet(a)
    rows = encode_available(spark, a, schema, TOK, out, at).collect()
    assert sorted(map(str, ((r["text"], r["ids"]) for r in rows))) == sorted(map(str, ((t, TOK.encode(t)) for t in TEXTS)))


def test_many_texts_encode_as_each_by_itself():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["the", "ing", " ", "é", "x", "\n"], k=rng.randrange(12))).encode() for _ in range(60)] + [b"", b"\xff\xfe"]
    ids, size = TOK.lattice.encode_all(texts)
    each = [TOK.lattice.encode(t) for t in texts]
    assert ids.tolist() == [i for e in each for i in e] and size.tolist() == [len(e) for e in each]
    key, n = TOK.lattice.pairs(texts)
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(m) for k, m in zip(key, n)} == Counter(p for e in each for p in zip(e, e[1:]))


def test_bad_bytes_are_replaced_in_decoding(spark):
    rows = spark.createDataFrame([([0xFF, 0x41],), ([0xC3, 256 + len(TOK.vocab) - 256, 0xA9],), ([0xC3, 0xA9],), (None,)], "ids array<int>")
    for specials in (True, False):
        got = [r[0] for r in rows.select(decode(spark, TOK, F.col("ids"), specials)).collect()]
        assert got == [TOK.decode([0xFF, 0x41], specials), TOK.decode([0xC3, len(TOK.vocab), 0xA9], specials), "é", None]


def test_draws_follow_the_sample_and_not_the_way(spark, monkeypatch):
    texts = [f"{k % 7} ab abc ab zz{k % 3}" for k in range(400)]
    draw = lambda df: {r[0]: r[1] for r in generate.document_frequency(df, max_bytes=4, p=0.3, added=["zz1"]).collect()}
    short = draw(samples(spark, texts))
    assert draw(samples(spark, texts).repartition(7)) == short  # partitions don't matter
    assert 0 < short["ab"] < 400 and len({short["0"], short["1"], short["2"]}) > 1  # copies of a text draw for themselves
    monkeypatch.setattr(generate, "LONG", 3)
    assert draw(samples(spark, texts)) == short


def test_limits_with_ties_and_empty_sources(spark, monkeypatch):
    monkeypatch.setattr(corpus, "STRIDE", 4)
    df = spark.createDataFrame([("a", i // 2, f"t{i}") for i in range(21)] + [("b", 5, "x"), (None, 1, "n"), (None, 2, "m")], "source string, sample_id long, text string")
    for share, n in ((0.5, 10), (0.0, 0), (0.99, 20)):
        got = corpus.prefix_sample(df, share).collect()
        mine = sorted((r["sample_id"], r["text"]) for r in got if r["source"] == "a")
        assert len(mine) == n and all(i <= n // 2 for i, _ in mine)
        assert [r["text"] for r in got if r["source"] is None] == ["n"] * (share > 0.4)
    assert corpus.prefix_sample(df, 1.0).count() == 24 and corpus.prefix_sample(df.limit(0), 0.5).count() == 0


def test_samples_count_in_the_order_of_files(spark, tmp_path):
    for k, size in ((2, 900), (1, 3), (0, 40)):
        (tmp_path / f"f{k}.bin").write_bytes(b"\0".join(f"{k}-{i}".encode() for i in range(size)))
    got = corpus.prefix_sample(corpus.read_samples(spark, str(tmp_path), "s"), 45 / 943).collect()
    assert sorted(r["text"] for r in got) == sorted([*(f"0-{i}" for i in range(40)), *(f"1-{i}" for i in range(3)), "2-0", "2-1"])
