"""Kernels and the driver-side tokenizer, without Spark."""

import itertools
import math
import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.functions.lattice import Lattice, NoPath, digamma, log_sum_exp
from lexloom.functions.patterns import NAMED
from lexloom.functions.tokenizer import Token, Tokenizer


def lattice(**scores):
    return Lattice([k.encode() for k in scores], list(scores.values()))


def paths(lat, text):
    """Every segmentation by recursion."""
    if not text:
        return [[]]
    return [[i, *p] for i, v in enumerate(lat.values) if text.startswith(v) for p in paths(lat, text[len(v) :])]


def test_best_path_prefers_the_longer_token():
    assert lattice(a=-3, b=-3, c=-3, ab=-4).encode(b"abc") == [3, 2]


def test_full_dropout_leaves_bytes():
    lat = Lattice([b"a", b"b", b"c", b"d", b"ab", b"abc", b"abcd"], [-3, -3, -3, -3, -4, -5, -6])
    assert lat.encode(b"abcd") == [6]
    assert lat.encode(b"abcd", 1.0, random.Random(1)) == [0, 1, 2, 3]
    halves = {tuple(lat.encode(b"abcd", 0.5, random.Random(k))) for k in range(40)}
    assert len(halves) > 2 and all(b"".join(lat.values[i] for i in h) == b"abcd" for h in halves)


def test_no_path_is_an_error():
    with pytest.raises(NoPath):
        lattice(a=-1).encode(b"ab")


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.integers(0, 10_000))
def test_chunks_viterbi_nbest_and_expected_match_brute_force(text, seed):
    rng = random.Random(seed)
    values = sorted({"a", "b", "c", *("".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(5))})
    lat = Lattice([v.encode() for v in values], [-rng.uniform(0.5, 6) for _ in values])
    raw = text.encode()
    assert b"".join(lat.chunks(raw)) == raw
    each = paths(lat, raw)
    score = lambda p: sum(lat.scores[i] for i in p)
    top = sorted(map(score, each), reverse=True)
    assert score(lat.encode(raw)) == pytest.approx(top[0])
    assert score(lat.viterbi(raw)[0]) == pytest.approx(top[0])
    assert [s for _, s in lat.nbest(raw, 4)] == pytest.approx(top[:4])
    total = sum(math.exp(s) for s in top)
    want = {}
    for p in each:
        for i in p:
            want[i] = want.get(i, 0) + math.exp(score(p)) / total
    whole, z = lat.expected(raw)
    assert z == pytest.approx(math.log(total))
    assert whole == pytest.approx(want)
    by_chunk = {}
    for c in lat.chunks(raw):
        for i, x in lat.expected(c)[0].items():
            by_chunk[i] = by_chunk.get(i, 0) + x
    assert by_chunk == pytest.approx(want)


def test_marginals_by_hand():
    lat = Lattice([b"<", b"DC", b" value", b">", b"<DC", b"<DC value>", b"DC value"], [-4, -5, -4, -3, -6, -12, -7])
    got = {lat.values[i]: x for i, x in lat.expected(b"<DC value>")[0].items()}
    want = {tuple(lat.values[i] for i in p): math.exp(sum(lat.scores[i] for i in p)) for p in paths(lat, b"<DC value>")}
    total = sum(want.values())
    for v, x in got.items():
        assert x == pytest.approx(sum(w for p, w in want.items() if v in p) / total)


def test_alternatives():
    lat = Lattice([b"a", b"b", b"ab", b"cd", b"ba"], [-1, -1, -1.5, -1, -5])
    assert lat.alternative(2) == (True, [0, 1])  # better than its parts
    assert lat.alternative(4) == (False, [])  # its parts are better
    assert lat.alternative(3) == (True, [])  # nothing else spells it


def test_digamma_and_log_sum_exp():
    for n in (1, 2, 10, 1000):
        assert digamma(n) == pytest.approx(-0.5772156649015329 + sum(1 / k for k in range(1, n)), abs=1e-9)
    assert log_sum_exp(float("-inf"), -2) == -2 and log_sum_exp(-1000, 0) == 0
    assert log_sum_exp(-1, -2) == pytest.approx(math.log(math.exp(-1) + math.exp(-2)))


def test_json_round_trip_and_strictness():
    tok = Tokenizer([Token(b"hello", 0.5), Token(b"\xff\xfe", -1.0, True), Token("é".encode(), -2.0)], ["crlf", "nfkc"], ["<s>"])
    back = Tokenizer.from_str(tok.to_string())
    assert back.vocab == tok.vocab and back.processors == tok.processors and back.special_tokens() == ["<s>"]
    assert tok.to_json()["vocab"][1] == {"value": "//4", "score": -1, "encoded": True, "keep": True}
    assert pickle.loads(pickle.dumps(tok)).to_string() == tok.to_string()
    for bad in ('{"version":"1.0"}', '{"version":"2.0","more":1}', '{"version":"2.0","vocab":[{"value":"a"}]}', '{"version":"2.0","vocab":[{"value":"a","score":1,"x":2}]}', "{}"):
        with pytest.raises(ValueError):
            Tokenizer.from_str(bad)
    assert Tokenizer.from_str('{"version":"2.0","processors":[{}]}').processors == ["crlf"]


BYTES = [Token(bytes([i]), 1 / 256) for i in range(256)]


def test_bytes_round_trip():
    text = "你好，世界。naïve"
    tok = Tokenizer(BYTES)
    assert tok.encode(text) == list(text.encode()) and tok.decode(tok.encode(text)) == text


@pytest.mark.parametrize(
    ("text", "want"),
    [("<E>Hi<E>", ["<E>", "Hi", "<E>"]), ("rstring", ["r", "st", "r", "ing"]), ("r<E_2>s", ["r", "<E_2>", "s"]), ("none", ["none"]), ("", [])],
)
def test_special_split(text, want):
    got = Tokenizer(BYTES, special_tokens=["<E>", "r", "<E_2>"]).split(text)
    assert [a for a, _ in got] == want and all(b == (a in ("<E>", "r", "<E_2>")) for a, b in got)


def test_first_special_of_the_list_wins_at_one_place():
    assert [a for a, _ in Tokenizer(BYTES, special_tokens=["ab", "abc"]).split("abcd")] == ["ab", "cd"]


def test_api_tour():
    tok = Tokenizer(BYTES, ["crlf"])
    tok.add_special_tokens(["<s>", "</s>", "<s>"])
    assert (tok.vocab_size(), tok.base_vocab_size(), tok.special_vocab_size()) == (258, 256, 2)
    ids = tok.encode("<s>a\r\nb</s>")
    assert ids == [256, 97, 10, 98, 257]
    assert tok.decode(ids) == "<s>a\nb</s>" and tok.decode(ids, False) == "a\nb"
    assert tok.encode_ordinary("<s>")[0] == ord("<")
    assert tok.special_token_to_id("<s>") == 256 and tok.id_to_special_token(257) == "</s>" and tok.id_to_special_token(3) is None
    assert tok.token_to_id(b"a") == 97 and tok.token_to_id("</s>") == 257 and tok.token_to_id("zz") is None
    assert tok.id_to_token(97) == b"a" and tok.id_to_token(256) == b"<s>" and tok.id_to_token(999) is None
    assert tok.id_to_base_token(97) == (b"a", 1 / 256) and tok.is_special(256) and not tok.is_base(256)
    assert tok.encode_batch(["a", "b"]) == [[97], [98]] and tok.decode_batch([[97], [256]], False) == ["a", ""]
    with pytest.raises(ValueError):
        tok.decode([999])
    tok.add_base_tokens([Token(b"ab", 5.0)])
    assert tok.special_token_to_id("<s>") == 257 and tok.encode("ab") == [256] and tok.common_prefix_search("abc") == [97, 256]
    assert tok.decode([0xE4, 97]) == "�a"
    with pytest.raises(ValueError):
        tok.add_special_tokens([""])


def test_there_are_37_patterns():
    assert len(NAMED) == 37
    assert len(set(itertools.chain(NAMED.values()))) == 37
