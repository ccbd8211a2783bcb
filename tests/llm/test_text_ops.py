"""Operators on the words of documents, against brute force."""

import random
import re

import numpy as np
import pytest

from lexloom.llm import decontam, quality, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "key long, id long, keys string, root long, n int, __lx_spans string"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def clashing(spark, rows):
    """With extra columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "x", 9, 1, "y") for i, t in rows], f"{SCHEMA}, {CLASH}")


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def tup(df):
    return sorted(map(tuple, df.collect()), key=str)


def rand(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# quality rules


def brute_repetition(text, least):
    w = words(text)
    n = len(w)
    on, longest = [False] * n, 0
    for i in range(n):
        for j in range(i):
            k = 0
            while max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                for a in (i, j):
                    on[a : a + k] = [True] * k
    return n, sum(on), longest


@pytest.mark.parametrize("seed", range(6))
def test_repetition_matches_brute_force(seed):
    rng = random.Random(seed)
    texts = [rand(rng, rng.randrange(60), 4 + seed) for _ in range(20)] + ["", None, "a a a a a a", "one", "!!!", "Ab ab AB aB ab"]
    for least in (1, 3, 8):
        n, covered, longest = quality.measure(texts, least)
        assert list(zip(n, covered, longest)) == [brute_repetition(t, least) for t in texts]


def test_repetition_decides(spark):
    rng = random.Random(1)
    rows = [(1, rand(rng, 400)), (2, rand(rng, 20) + " " + ("say it again and again my dear old friend " * 30)), (3, None), (4, ""), (None, "x"), (1, "x"), (5, "word " * 30_000)]
    got = {(r["doc_id"], r["n_words"]): r["keep"] for r in quality.repetition(docs(spark, rows)).collect()}
    assert got == {(1, 400): True, (2, 290): False, (3, 0): True, (4, 0): True, (None, 1): True, (1, 1): True, (5, 30_000): False}
    kept = quality.kept(clashing(spark, rows))
    assert kept.columns == clashing(spark, []).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "4", "None"]
    assert quality.kept(docs(spark, [])).count() == 0 and quality.repetition(docs(spark, [])).count() == 0


# decontamination

ITEMS = [(1, "what is the tallest mountain on the whole planet earth today"), (2, "two plus two equals"), (3, "short one"), (4, None), (5, "what is the tallest mountain on the whole planet earth today"), (None, "nobody knows this line at all or ever did")]


def brute_spans(text, items):
    w, out = words(text), set()
    for item, q in items:
        g = words(q)
        n = min(8, len(g))
        if item is None or n < 4:
            continue
        grams = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)}
        on = [False] * (len(w) + 1)
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                on[i : i + n] = [True] * n
        at = 0
        while at < len(w):
            if on[at]:
                end = at
                while on[end]:
                    end += 1
                out.add((item, at, end))
                at = end
            at += 1
    return out


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WORDS, 0])
def test_decontamination_matches_brute_force(spark, limit):
    rng = random.Random(5)
    q = ITEMS[0][1]
    rows = [(1, f"{rand(rng, 30)} {q.upper()}! {rand(rng, 9)}"), (2, q), (3, rand(rng, 50)), (4, None), (5, ""), (6, "Two, plus two; equals four. two plus two equals"), (None, q), (7, "what is the tallest mountain on the small planet"), (8, rand(rng, 60_000) + " " + q), (1, f"{rand(rng, 30)}")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontam.contamination(docs(spark, rows), bench, broadcast_words=limit).collect()}
    assert got == {(i, *s) for i, t in rows if i is not None for s in brute_spans(t, ITEMS)}
    left = {(r["doc_id"], r["n_chars"]): r["text"] for r in decontam.decontaminated(clashing(spark, rows), bench, broadcast_words=limit).collect()}
    texts = [t for (i, _), t in left.items() if i == 1]
    assert not any(i in (2, 6) for i, _ in left) and all("mountain" not in t.lower() for t in texts) and len(texts) == 2
    assert not any(i is None for i, _ in left) and left[3, len(rows[2][1])] == rows[2][1] and left[7, len(rows[7][1])] == rows[7][1]
    assert all(n == len(t or "") for (_, n), t in left.items())
    part = decontam.decontaminated(docs(spark, [(None, f"{rand(rng, 30)} {q}")]), bench, broadcast_words=limit).collect()
    assert len(part) == 1 and "mountain" not in part[0]["text"]  # cutting needs no id
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs(spark, rows), none, broadcast_words=limit).count() == 0
    assert decontam.decontaminated(docs(spark, []), bench, broadcast_words=limit).count() == 0


# repeated passages


def brute_passages(rows, length):
    first, marked = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for a in range(len(w) - length + 1):
            g = tuple(w[a : a + length])
            first.setdefault(g, (i, a))
            if first[g] != (i, a):
                marked.setdefault((i, first[g][0]), set()).add(a)
    out = set()
    for (i, src), at in marked.items():
        start = prev = None
        for a in sorted(at):
            if prev is None or a != prev + 1:
                if prev is not None:
                    out.add((i, start, prev + length, src))
                start = a
            prev = a
        out.add((i, start, prev + length, src))
    return out


@pytest.mark.parametrize(("seed", "hot", "rounds"), [(0, 1 << 40, 3), (1, 1 << 40, 0), (2, 100, 1), (3, 0, 3)])
def test_passages_match_brute_force(spark, monkeypatch, seed, hot, rounds):
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    rng = random.Random(seed)
    shared = [rand(rng, rng.randrange(6, 20), 50) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [rand(rng, rng.randrange(1, 12), 30)]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), rand(rng, rng.randrange(1, 9), 30)]
        rows.append((i, " ".join(parts)))
    rows += [(90, None), (91, ""), (92, "a"), (93, "x y " * 30), (94, rows[0][1]), (None, rows[0][1])]
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in suffix_dedup.repeated_passages(docs(spark, rows), 6, 3, hot).collect()}
    assert got == brute_passages(rows, 6)


def test_cut_leaves_the_first(spark):
    rng = random.Random(8)
    passage = rand(rng, 70, 10_000)
    rows = [(5, f"{rand(rng, 20)} {passage} tail one"), (3, f"head {passage}"), (4, passage), (9, "clean text here"), (None, passage), (6, None), (7, ""), (8, rand(rng, 60_000, 10_000) + " " + passage)]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut(clashing(spark, rows)).collect()}
    assert got[3] == rows[1][1] and got[9] == "clean text here" and got[None] == passage and got[6] is None and got[7] == ""
    assert 4 not in got and got[5] == f"{rows[0][1].split(passage)[0]}tail one" and passage not in got[8]
    twice = {r["doc_id"] for r in suffix_dedup.repeated_passages(docs(spark, [(1, passage), (1, passage)])).collect()}
    assert not twice  # one document
    assert suffix_dedup.repeated_passages(docs(spark, [])).count() == 0 and suffix_dedup.cut(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_first_places_match_brute_force(monkeypatch, rounds):
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    rng = np.random.default_rng(9)
    for _ in range(30):
        size = rng.integers(4, 14, 12)
        text, start = rng.integers(0, 3, int(size.sum())), np.cumsum(size) - size
        got = suffix_dedup.first_places(text, start, size, np.zeros(12, np.int64), 4)
        seen, want = {}, np.full(len(text), -1)
        for a, n in zip(start.tolist(), size.tolist()):
            for k in range(a, a + n - 3):
                want[k] = seen.setdefault(tuple(text[k : k + 4].tolist()), k)
        assert np.array_equal(got, want)


def test_the_index_follows_the_number_of_runs():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1000, 200)
    sizes = [suffix_dedup.RunLengthIndex(np.append(np.tile(base, k), 0), 50).runs() for k in (1, 4, 64)]
    assert sizes[2] <= sizes[0] + 2 and sizes[1] <= sizes[0] + 2
    assert suffix_dedup.RunLengthIndex(np.append(rng.integers(1, 1000, 12_800), 0), 50).runs() > 50 * sizes[0]


def test_matching_statistics_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(5):
        seq = np.append(rng.integers(1, 5, 60), 0)
        pattern = rng.integers(1, 6, 40)
        index = suffix_dedup.RunLengthIndex(seq, 3)
        _, got = index.matching_statistics(pattern, np.array([0, 15]), np.array([15, 25]))
        text = seq.tolist()
        for a, z in ((0, 15), (15, 40)):
            for i in range(a, z):
                best = max(k for k in range(z - i + 1) if k == 0 or any(text[j : j + k] == pattern[i : i + k].tolist() for j in range(len(text))))
                assert got[i] == best or min(got[i], best) >= 3  # exact below the index's length


# near duplicates


@pytest.mark.parametrize("most", [7, 50_000])
def test_trie_join_matches_brute_force(most):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 30, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base, base[:3]])
    group = rng.integers(0, 3, len(fp))
    i, j = simhash.trie_join(fp, group, 4, most)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}


def brute_groups(ids, ok):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and ok(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {(i, top(i)) for i in ids if top(i) != i}


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_near_duplicates_match_brute_force(spark, hot):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        w = rand(rng, 150, 3000).split()
        for c in range(rng.randrange(1, 6)):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            rows.append((100 - len(rows), " ".join(v)))
    clean = len(rows)
    rows += [(200, None), (201, ""), (202, "!!"), (None, rows[0][1])]
    prints = simhash.fingerprints([t for _, t in rows[:clean]])
    views = list(simhash.codes(prints[:, :4]))
    at = {i: k for k, (i, _) in enumerate(rows[:clean])}

    def near(a, b):
        a, b = at[a], at[b]
        differ = [int(v[a] ^ v[b]) for v in views]
        found = any(d >> (64 - simhash.PREFIX) == 0 and d.bit_count() <= simhash.BITS for d in differ)
        return found and sum(int(x).bit_count() for x in prints[a, 4:] ^ prints[b, 4:]) <= simhash.CONFIRM

    want = brute_groups(list(at), near)
    assert want
    assert {tuple(r) for r in simhash.near_duplicates(docs(spark, rows), hot=hot, every=1).collect()} == want
    left = simhash.deduplicated(clashing(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(i) for i, _ in rows if i not in dict(want))


def test_codes_are_the_bits_of_their_view():
    prints = simhash.fingerprints(["a few words of text", "other words altogether in this one"])
    bits = [[int(prints[d, b // 64]) >> (b % 64) & 1 for b in range(simhash.POOL)] for d in range(2)]
    for order, code in zip(simhash.orders(), simhash.codes(prints[:, :4])):
        for d in range(2):
            assert int(code[d]) == sum(bits[d][b] << (63 - k) for k, b in enumerate(order.tolist()))


def test_nothing_goes_from_unrelated_long_texts_of_one_language(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(4000)]
    share = [1 / (k + 1) for k in range(4000)]
    rows = [(i, " ".join(rng.choices(vocab, share, k=rng.randrange(300, 3000)))) for i in range(520)]
    assert simhash.near_duplicates(docs(spark, rows)).count() == 0


def test_short_texts_are_copies_only_if_equal(spark):
    rows = [(1, "one"), (2, "One!"), (3, "two"), (4, "one two"), (5, "two one"), (6, "one, two"), (7, "one two three four"), (8, "one two three five")]
    assert tup(simhash.near_duplicates(docs(spark, rows))) == [(2, 1), (6, 4)]


def test_copies_ties_and_empty_tables(spark):
    text = rand(random.Random(0), 80)
    rows = [(5, text), (3, text), (3, text), (9, text.upper() + "!"), (7, "something else altogether")]
    assert tup(simhash.near_duplicates(docs(spark, rows))) == [(5, 3), (9, 3)]
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs(spark, rows)).collect()) == [3, 3, 7]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.deduplicated(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_long_documents_fold_in_pieces():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 130_000, dtype=np.uint64)
    ones = [2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    got = int(simhash.fold(h, np.zeros(len(h), np.int64), 1)[0])
    assert all((got >> b & 1) == (n > len(h)) for b, n in enumerate(ones) if n != len(h))


def test_long_documents_of_one_language_stay_and_edited_copies_go(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    prose = lambda n: rng.choices(vocab, [1 / (k + 1) for k in range(3000)], k=n)
    texts = [prose(rng.randrange(1500, 4000)) for _ in range(60)]
    for k in range(20):
        base = prose(rng.randrange(80, 300))
        copy = list(base)
        for at in rng.sample(range(len(copy)), len(copy) // 25):
            copy[at] = f"new{k}x{at}"
        texts += [base, copy]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    share = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    near = dict(brute_groups(range(len(rows)), lambda a, b: share(a, b) >= 0.6))
    got = dict(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()))
    assert len(near) == 20 and all(near.get(i) == k for i, k in got.items())
    assert len(got) >= 0.9 * len(near)


def test_rows_that_share_a_doc_id_are_each_worked_on(spark):
    rng = random.Random(6)
    text, clean, passage = rand(rng, 80, 10_000), rand(rng, 90, 10_000), rand(rng, 60, 10_000)
    rows = [(3, text), (5, clean), (5, text.upper()), (5, None)]
    assert tup(simhash.near_duplicates(docs(spark, rows))) == [(5, 3)]
    assert sorted(str(r["text"]) for r in simhash.deduplicated(docs(spark, rows)).collect()) == sorted([text, clean, "None"])
    other = rand(rng, 200, 10_000)
    got = [r["text"] for r in suffix_dedup.cut(docs(spark, [(1, passage), (2, other), (2, f"{passage} tail")])).collect()]
    assert sorted(got) == sorted([passage, other, "tail"])
