"""Token counts, language model, URL filter, packing, HTML, language identification."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import html_template, language_id, ngram_lm, packing, token_counts, url_filter
from lexloom.llm._bpe import chunks
from lexloom.llm._eliasfano import EliasFano

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang[0] if lang else "en", "s", len(t or ""), 1, 2) for i, t, *lang in rows], SCHEMA)


TEXTS = ["Hello world.\nA second line,  with spaces \n\n\nand blank ones", "", None, "naïve café — 日本語\n\U0001f600 emoji", "\n", "x" * 50_000, "no end\n"]

# token counts


def brute_counts(text, rule):
    enc = chunks().encoding
    spans, at = [], 0
    raw = text.encode()
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        spans.append((char_of[at], char_of[at + size - 1] + 1))
        at += size
    assert at == len(raw)
    edges, at = [0], 0
    for line in text.split("\n"):
        at += len(line) + 1
        edges.append(min(at, len(text)))
    edges = sorted(set(edges))
    out = []
    for lo, hi in zip(edges, edges[1:]):
        n = cross = 0
        for a, b in spans:
            share = min(b, hi) - max(a, lo)
            if share <= 0:
                continue
            whole = a >= lo and b <= hi
            cross += not whole
            if rule == "fraction":
                n += share / (b - a)
            elif rule == "start":
                n += lo <= a < hi
            else:
                parts = [(min(b, z) - max(a, y), -y) for y, z in zip(edges, edges[1:]) if min(b, z) > max(a, y)]
                n += max(parts)[1] == -lo
        out.append((lo, hi, pytest.approx(n), cross))
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_match_brute_force(spark, rule):
    rows = list(enumerate(TEXTS)) + [(None, "a\nb"), (0, "again")]
    got = {}
    for r in token_counts.section_tokens(docs(spark, rows), rule).collect():
        got.setdefault((r["doc_id"], r["end_char"] >= 0), []).append((r["section"], r["start_char"], r["end_char"], r["n_tokens"], r["n_crossing"]))
    for i, t in list(enumerate(TEXTS))[1:]:
        have = sorted(got.get((i, True), []))
        assert [s for s, *_ in have] == list(range(len(have)))
        assert [x[1:] for x in have] == (brute_counts(t, rule) if t else [])
    assert sum(x[3] for x in got[None, True]) == len(chunks().encoding.encode_ordinary("a\nb"))
    assert token_counts.section_tokens(docs(spark, []), rule).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs(spark, []), "none")


def test_chunked_encoding_is_the_tokenizers_own():
    rng = random.Random(3)
    texts = ["".join(rng.choices(" \n\t  aé1.'日s't　", k=rng.randrange(80))) for _ in range(300)]
    ids, bounds = chunks().encode(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == chunks().encoding.encode_ordinary(t)
    assert chunks().counts(texts).tolist() == np.diff(bounds).tolist()


# language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (300, 40), (1000, 10**12), (64, 0)):
        v = np.sort(rng.integers(0, top + 1, n))
        seq = EliasFano.build(v)
        assert np.array_equal(seq[np.arange(n)], v.astype(np.uint64))
        x = rng.integers(0, top + 3, 200)
        assert np.array_equal(seq.next_geq(x), np.searchsorted(v, x))


def brute_scores(texts):
    each = [[w.lower() for w in re.findall(r"[^\W_]+", t or "")] for t in texts]
    q = lambda p: int(ngram_lm.quantised(np.array([p]))[0])
    c1 = Counter(w for d in each for w in d)
    tri = Counter((d[i - 2] if i > 1 else None, d[i - 1], d[i]) for d in each for i in range(1, len(d)))
    c2, ctx2, c12 = Counter(), Counter(), Counter()
    for (a, b, c), n in tri.items():
        c2[b, c] += n
        ctx2[b] += n
        c12[a, b] += n
    total, mu = sum(c1.values()), ngram_lm.MU
    out = []
    for d in each:
        bits = 0
        for i in range(1, len(d)):
            a, b, c = d[i - 2] if i > 1 else None, d[i - 1], d[i]
            p1 = (c1[c] + 1) / (total + len(c1) + 1)
            p2 = 2.0 ** (-q((c2[b, c] + mu * p1) / (ctx2[b] + mu)) / ngram_lm.STEP)
            bits += q((tri[a, b, c] + mu * p2) / (c12[a, b] + mu))
        out.append((max(len(d) - 1, 0), bits / ngram_lm.STEP))
    return out


@pytest.mark.parametrize("shard_words", [1_000_000, 150])
def test_scores_match_brute_force(spark, shard_words):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("the a of to cat dog sat on mat big red".split(), weights=[40, 9, 5, 5, 3, 3, 3, 3, 2, 1, 1], k=rng.randrange(50))) for _ in range(60)] + [None, "", "one", "The! the"]
    got = {r["doc_id"]: (r["n_scored"], r["bits"]) for r in ngram_lm.scores(docs(spark, list(enumerate(texts))), shard_words).collect()}
    assert got == dict(enumerate(brute_scores(texts)))
    r = next(r for r in ngram_lm.scores(docs(spark, [(1, "a b a b a b")])).collect())
    assert r["bits_per_word"] == pytest.approx(r["bits"] / 5) and r["perplexity"] == pytest.approx(2 ** r["bits_per_word"])


def test_scores_edges(spark):
    rows = ngram_lm.scores(docs(spark, [(None, "a b c"), (1, "a b"), (1, "a b"), (2, "x")])).collect()
    assert sorted((r["doc_id"], r["n_scored"]) for r in rows) == [(1, 1), (1, 1), (2, 0)]
    assert next(r for r in rows if r["doc_id"] == 2)["bits_per_word"] is None
    assert ngram_lm.scores(docs(spark, [])).count() == 0


# URL filter

URLS = ["http://bad.org/x", "https://User@WWW.Sub.Bad.org:80/a?b#c", "bad.org", "//bad.org/", "http://notbad.org", "http://ok.org/spam/page", "http://ok.org/spam?x=1", "http://ok.org/spammy", None, "", "http:///x", "http://ok.org/spam/deep/er"]


def test_urls(spark):
    entries = ["BAD.org", "ok.org/spam", "ok.org/spam/deep", None, "", "bad.org"]
    want = ["bad.org", "bad.org", "bad.org", "bad.org", None, "ok.org/spam", "ok.org/spam", None, None, None, None, "ok.org/spam/deep"]
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], None, 1)], "page_id long, url string, html string, entry int")
    table = spark.createDataFrame([(e, 1) for e in entries], "u string, url int")
    for given in (entries, table):
        got = sorted((r["page_id"], r["blocked"], r["entry"] or "") for r in url_filter.filtered(pages, given).collect())
        assert got == sorted([(i, w is not None, w or "") for i, w in enumerate(want)] + [(0, True, "bad.org")])
    assert not any(r["blocked"] for r in url_filter.filtered(pages, []).collect())
    assert url_filter.filtered(pages.limit(0), entries).count() == 0


def test_digests_that_collide_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    url_filter.write_part(str(tmp_path), 0, ["a.org", "b.org"])
    assert url_filter.DigestArray(str(tmp_path), 0, {0}).contains(["b.org", "c.org", "a.org"]).tolist() == [True, False, True]


def test_a_part_that_is_gone_is_an_error(spark, tmp_path):
    url_filter.write_part(str(tmp_path), 0, ["a.org"])
    held = url_filter.DigestArray(str(tmp_path), 0, {0})
    (tmp_path / "urls-0").unlink()
    with pytest.raises(FileNotFoundError):
        held.contains(["a.org"])


def test_a_very_long_url_and_a_list_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PER_FILE", 40)
    entries = spark.range(300).selectExpr("concat('h', id, '.org/p') as entry", "id")
    long = "http://h7.org/p/" + "x/" * 3000
    pages = spark.createDataFrame([(1, long), (2, "http://h8.org/q"), (3, "https://h299.org/p?z")], "page_id long, url string")
    got = {r["page_id"]: r["entry"] for r in url_filter.filtered(pages, entries).collect()}
    assert got == {1: "h7.org/p", 2: None, 3: "h299.org/p"}


def test_shared_folders(spark):
    from lexloom.llm import _spark

    assert _spark.local_path("file:/a/b") == _spark.local_path("file:///a/b") == _spark.local_path("/a/b") == "/a/b"
    for path in ("hdfs://x/a", "s3a://x/a", "a/b"):
        with pytest.raises(ValueError):
            _spark.local_path(path)

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(RuntimeError):
        _spark.shared_dir(Session())


# packing


def fewest(sizes, room):
    """The least number of packs, over all subsets."""
    full = (1 << len(sizes)) - 1
    best = {0: (0, room)}
    for m in range(1, full + 1):
        each = []
        for k, n in enumerate(sizes):
            if m >> k & 1:
                packs, used = best[m ^ (1 << k)]
                each.append((packs, used + n) if used + n <= room else (packs + 1, n))
        best[m] = min(each)
    return best[full][0]


@pytest.mark.parametrize("seed", range(3))
def test_packs_against_the_fewest_possible(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        sizes = rng.integers(1, 65, rng.integers(1, 10))
        used = len(np.unique(packing.pack(sizes, 64, 16, 3)))
        best = fewest(sizes.tolist(), 64)
        assert best <= used <= best + 1


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-6).all() and abs(g @ x) < 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_packs_hold_everything_once(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 257, 500)
    p = packing.pack(n, 256, 16, 3)
    used = np.bincount(p, n)
    assert (used <= 256).all() and (p >= 0).all() and n.sum() / (256 * len(used)) > 0.9
    assert len(packing.pack(np.zeros(0, np.int64))) == 0


def test_packed(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 400)))) for i in range(60)] + [(90, None), (91, ""), (92, "a b c " * 9000), (None, "null id"), (1, "repeated id")]
    got = packing.packed(docs(spark, rows), group=20).collect()
    want = Counter()
    for i, t in rows:
        want[i] += len(chunks().encoding.encode_ordinary(t or ""))
    have, room, slots = Counter(), Counter(), {}
    for r in got:
        have[r["doc_id"]] += r["n_tokens"]
        room[r["pack_id"]] += r["n_tokens"]
        slots.setdefault(r["pack_id"], []).append(r["slot"])
    assert have == +want and max(room.values()) <= packing.WINDOW and all(sorted(s) == list(range(len(s))) for s in slots.values())
    long = sorted((r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 92)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and long[0][0] == 0
    assert packing.packed(docs(spark, [])).count() == 0


# HTML


def page(title, items, extra=""):
    li = "".join(f"<li><b>{a}</b> <i>{b}</i></li>" for a, b in items)
    return f"<html><head><title>{title}</title></head><body><div class=top>Menu Home</div>{extra}<ul>{li}</ul><div class=foot>Terms</div></body></html>"


def test_template_and_slots(spark):
    rows = [(i, f"http://h.org/{i}", page(f"Title{i}", [(f"k{i}{j}", f"v{i}{j}" + " R&amp;D" * (j == 2)) for j in range(1 + i % 3)])) for i in range(8)]
    rows += [(20, "http://solo.org/", "<p>only   page</p>"), (21, "http://h.org/x", None), (22, "http://h.org/y", ""), (23, None, "<p>no host</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, token string, host int")
    got = html_template.extracted(pages).collect()
    first = sorted((r["slot"], r["turn"], r["text"]) for r in got if r["page_id"] == 2)
    assert [t for *_, t in first if t.startswith("Title")] == ["Title2"]
    texts = " ".join(t for *_, t in first)
    assert all(f"k2{j}" in texts and f"v2{j}" in texts for j in range(3)) and "R&D" in texts and "Menu" not in texts and "Terms" not in texts
    assert len({turn for _, turn, t in first if t.startswith(("k", "v"))}) == 3  # one turn for each item
    by = {r["page_id"]: (r["slot"], r["text"]) for r in got}
    assert by[20] == (-1, "only page") and by[23] == (-1, "no host") and 21 not in by and 22 not in by
    assert html_template.extracted(pages.limit(0)).count() == 0


def test_a_page_that_differs_gives_its_whole_text(spark):
    rows = [(i, "http://h.org/", page(f"T{i}", [("a", f"b{i}")])) for i in range(6)] + [(9, "http://h.org/", "<p>quite another page</p>")]
    got = {r["page_id"]: (r["slot"], r["text"]) for r in html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == (-1, "quite another page") and got[0][0] >= 0


def test_a_word_out_of_order_does_not_spoil_the_template(spark):
    rows = [(i, "http://h.org/", page(f"T{i}" + " today" * (i % 2), [("a", f"b{i}" + " today" * (1 - i % 2))])) for i in range(6)]
    got = html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for i in range(6):
        mine = [r for r in got if r["page_id"] == i]
        assert all(r["slot"] >= 0 for r in mine)
        assert sorted(w for r in mine for w in r["text"].split()) == sorted([f"T{i}", f"b{i}", "today"])


def test_in_order_matches_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        ranks, weights = rng.sample(range(n), n), [rng.choice([1, n + 1]) for _ in range(n)]
        kept = html_template.in_order(ranks, weights)
        assert [r for r in ranks if r in kept] == sorted(kept)
        subsets = [[r for b, r in enumerate(ranks) if m >> b & 1] for m in range(1 << n)]
        assert sum(weights[r] for r in kept) == max(sum(weights[r] for r in x) for x in subsets if x == sorted(x))


def brute_template(pages):
    """The largest class of tokens that are once on the same pages, on half of them at least; and classes that lie in one of its slots."""
    each = [html_template.tokens(p) for p in pages]
    vectors = {}
    for t in {t for toks in each for t in toks}:
        v = tuple(toks.count(t) for toks in each)
        if sum(map(bool, v)) * 2 >= len(pages):
            vectors.setdefault(v, []).append(t)
    single = [(sum(v), len(c), c) for v, c in vectors.items() if max(v) == 1 and len(c) >= 3]
    best = max(single, key=lambda x: x[:2])[2]
    page = next(toks for toks in each if best[0] in toks)
    skeleton = sorted(best, key=page.index)
    nested = {}
    for c in vectors.values():
        if c is best or len(c) < 2:
            continue
        slots, order = set(), set()
        for toks in each:
            mine = [t for t in toks if t in c]
            order.add(tuple(mine[: len(c)]))
            ok = len(mine) % len(c) == 0 and mine == mine[: len(c)] * (len(mine) // len(c))
            slots |= {sum(toks.index(s) < i for s in skeleton) for i, t in enumerate(toks) if t in c} | (set() if ok else {-1})
        if len(slots) == 1 and -1 not in slots:
            nested[next(o for o in order if o)] = slots.pop()
    return skeleton, nested


@pytest.mark.parametrize("seed", range(3))
def test_templates_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    made = [page(word(), [(word(), word()) for _ in range(rng.randrange(1, 5))], f"<p id=a><q>{word()}</q></p>" if seed else "") for _ in range(9)]
    rows = [(i, "http://h.org/", html) for i, html in enumerate(made)] * 2  # repeated rows count once
    got = html_template.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    t = json.loads(got[0]["template"])
    skeleton, nested = brute_template(made)
    assert len(got) == 1 and t["skeleton"] == skeleton
    assert {tuple(c): slot for c, slot in zip(t["nested"], t["slots"])} == nested


@pytest.mark.parametrize("limit", [html_template.BROADCAST_BYTES, 0])
def test_templates_by_join_and_in_small_runs(spark, monkeypatch, limit):
    rows = [(i, f"http://h{i % 3}.org/", page(f"T{i}", [("a", f"b{i}")] * (1 + i % 4))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_template.extracted(pages).collect()))
    monkeypatch.setattr(html_template, "BROADCAST_BYTES", limit)
    got = sorted(map(tuple, html_template.extracted(pages.repartition(30, "page_id")).collect()))
    assert got == want and all(r[2] >= 0 for r in got)


def test_extraction_of_ties_long_pages_and_shared_ids(spark):
    rows = [(i % 2, f"http://h.org/{i}", page(f"T{i}", [("a", f"b{i}")] * (3000 if i == 0 else 1))) for i in range(6)]
    got = html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["slot"] >= 0 for r in got)
    assert sorted(r["text"] for r in got if r["text"].startswith("T")) == [f"T{i}" for i in range(6)]
    assert sum(r["text"] == "b0" for r in got) == 3000


# language identification


def brute_probabilities(net, raw):
    """Both networks read byte by byte; the softmax of the layer on their states."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h, states = net.h, {}
    for d, bytes_ in (("f", raw), ("b", raw[::-1])):
        s, out = np.zeros(h), []
        for b in bytes_:
            a, g = net.p["e" + d][:, b].astype(float), net.p["u" + d].astype(float) @ s
            z, r = sigmoid(a[:h] + g[:h]), sigmoid(a[h : 2 * h] + g[h : 2 * h])
            n = np.tanh(a[2 * h :] + r * (g[2 * h :] + net.p["c" + d][:, 0]))
            s = (1 - z) * n + z * s
            out.append(s)
        states[d] = out if d == "f" else out[::-1]
    z = [net.p["w"] @ np.concatenate(p) + net.p["b"][:, 0] for p in zip(states["f"], states["b"])]
    return np.array([np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in z])


def test_forward_and_pooling_match_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "SCORED", 20)
    net = language_id.Network(3, 5, seed=4)
    texts = ["a short text", "é" * 33, "", None, "x", "one two three four five six seven eight nine ten"]
    mean, share, n = language_id.pooled(net, texts, block=2)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert n[k] == len(raw)
        if raw:
            p = np.concatenate([brute_probabilities(net, raw[a : a + 20]) for a in range(0, len(raw), 20)])
            assert np.allclose(mean[k], p.mean(0), atol=1e-5)
            assert share[k] == pytest.approx((p.argmax(1) == p.mean(0).argmax()).mean())


def test_the_sample_is_equal_by_language_and_whole(spark):
    rows = [(i, f"text {i} " * 50, "en") for i in range(200)] + [(1000 + i, f"mot {i}", "fr") for i in range(5)] + [(7, "text 7 " * 50, "en")] * 30 + [(None, "sans id", "fr")]
    got = language_id.sample(docs(spark, rows), 20)
    by = Counter(lang for _, lang in got)
    assert by == {"en": 10, "fr": 6} and len(set(got)) == 16 and all(len(t) > 300 for t, lang in got if lang == "en")
    names, net = language_id.trained([("only one", "en")])
    assert names == ["en"] and language_id.pooled(net, ["abc"])[0].tolist() == [[1.0]]


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, length, _ = language_id.windows([b"hello", b"abc de", b"z"], 8)
    y, weight = np.array([0, 2, 1]), np.ones(3)
    _, grad = net.gradient(x, length, y, weight)
    for k, v in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in v.shape)
            if k[0] == "e":
                at = (at[0], int(x[0, 0]))
            old, e = v[at], 1e-2
            v[at] = old + e
            hi = net.gradient(x, length, y, weight)[0]
            v[at] = old - e
            lo = net.gradient(x, length, y, weight)[0]
            v[at] = old
            assert grad[k][at] == pytest.approx((hi - lo) / (2 * e), abs=2e-3)


WORDS = {"aa": "the and with house water green over".split(), "bb": "der und mit haus wasser grün über".split(), "cc": "le et avec maison eau vert où".split()}


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    text = lambda lang: " ".join(rng.choices(WORDS[lang], k=rng.randrange(5, 60)))
    train = [(i, text(lang), lang) for i, lang in enumerate(list(WORDS) * 60)]
    model = language_id.trained([(t, lang) for _, t, lang in train])
    held = [(i, text(lang), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(900, None, "aa"), (901, "", "aa"), (None, "und mit haus", "bb"), (902, "the house " * 9000, "aa")]
    got = language_id.identified(docs(spark, held), model=model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(held)
    assert sum(by[i]["language"] == lang for i, _, lang in held[:90]) >= 85
    assert by[900]["language"] is None and by[901]["probability"] is None and by[None]["language"] == "bb" and by[902]["language"] == "aa"
    assert 0 < by[0]["probability"] <= 1 and 0 <= by[0]["position_share"] <= 1 and math.isclose(by[0]["n_bytes"], len(held[0][1].encode()))


def test_without_labels_there_is_no_model(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: (r["language"], r["n_bytes"]) for r in language_id.identified(rows).collect()} == {1: (None, 3), 2: (None, 0)}
    assert language_id.identified(docs(spark, [])).count() == 0
