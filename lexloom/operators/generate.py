"""A seed vocabulary from the number of samples that hold each short substring.

Samples are scanned once.  A task gathers samples until their distinct pieces have many
substrings, lists these by length and numbers them in arrays, and adds up for each sample;
so the shuffle carries at most one row per distinct token and group of samples, not one
per (sample, token), and a worker's memory doesn't grow with its input.  The rest is relational.

Draws depend on the sample (source and sample_id, where they are there) and the token
alone: not on partitions, on the order of samples, or on copies of a text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.patterns import allow_regex, mine_regex

PROBABILITY, MAX_BYTES = 0.1, 24
#: A group's substrings by place, and its samples, at most; rows of a batch that are taken apart at a time.
HELD, SAMPLES, ROWS = 8_000_000, 20_000, 200
LONG = 100_000
#: Characters of the substrings that are bounded first; tokens that are counted one by one, at most; pieces or substrings, and characters, that a worker holds.
GRAM, BOUND, WORDS, CHARS = 4, 400_000, 300_000, 100_000_000
LISTED_CHARS = 20_000_000
#: Bytes of the cached token numbers of pieces that a worker holds; listed tokens up to which each is looked for by itself.
CACHED, FEW = 64_000_000, 32


def substrings(piece: str, max_bytes: int) -> list[str]:
    """Every substring of at most ``max_bytes`` bytes, one for each place."""
    if piece.isascii():
        n = len(piece)
        return [piece[i:j] for i in range(n) for j in range(i + 1, min(n, i + max_bytes) + 1)]
    width = [len(c.encode()) for c in piece]
    out = []
    for i in range(len(piece)):
        size = 0
        for j in range(i, len(piece)):
            size += width[j]
            if size > max_bytes:
                break
            out.append(piece[i : j + 1])
    return out


def _windows(piece: str, max_bytes: int, step: int) -> Iterator[list[str]]:
    """The substrings of a long piece by the place at which they start, ``step`` places at a time."""
    for a in range(0, len(piece), step):
        cut = piece[a : a + step + max_bytes]
        if len(cut) <= step:
            yield substrings(cut, max_bytes)
            continue
        yield [s for i in range(min(step, len(cut))) for s in _prefixes(cut[i : i + max_bytes], max_bytes)]


def _prefixes(s: str, max_bytes: int) -> list[str]:
    out, size = [], 0
    for j, c in enumerate(s):
        size += len(c.encode())
        if size > max_bytes:
            break
        out.append(s[: j + 1])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, with its default seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + p5) ^ (turn(x * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _token_hash(tokens: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens], np.uint64)


def _drawn(sample: int, tokens: np.ndarray, k: np.ndarray, p: float) -> np.ndarray:
    """Whether at least one of k occurrences of each token hash is drawn in the sample."""
    u = (_mixed(tokens ^ np.uint64(sample & 0xFFFFFFFFFFFFFFFF)) & np.uint64((1 << 52) - 1)).astype(float) / (1 << 52)
    return u < (1 - (1 - p) ** np.arange(k.max(initial=0) + 1))[k]


class _Group:
    """Samples of a task until their distinct pieces have ``HELD`` substrings; these are then listed, and numbered, in arrays."""

    def __init__(self, max_bytes: int, skip: frozenset[str], p: float) -> None:
        self.max_bytes, self.skip, self.p = max_bytes, skip, p
        self.number: dict[str, int] = {}
        self.size: list[int] = []
        self.places = 0
        self.samples: list[np.ndarray] = []
        self.keys: list[int] = []

    def add(self, pieces: list[str], key: int) -> None:
        number = self.number
        self.samples.append(np.array([number.setdefault(piece, len(number)) for piece in pieces], np.int32))
        self.keys.append(key)
        new = [len(piece) if piece.isascii() else len(piece.encode()) for piece in islice(reversed(number), len(number) - len(self.size))]
        self.size += new[::-1]
        m = self.max_bytes
        self.places += sum(n * (n + 1) // 2 if n <= m else n * m - m * (m - 1) // 2 for n in new)

    def _listed(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(the distinct substrings, their numbers piece by piece, where each piece's begin)."""
        size = np.array(self.size, np.int64)
        raw = np.frombuffer("".join(self.number).encode(), np.uint8)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        begins = np.append((raw & 0xC0) != 0x80, True)  # a substring begins and ends between characters
        at = np.flatnonzero(begins[:-1])
        left = np.cumsum(size)[owner[at]] - at
        found, words, base = [], [], 0
        for n in range(1, self.max_bytes + 1):
            fits = left >= n
            at, left = at[fits], left[fits]
            if not len(at):
                break
            here = at[begins[at + n]]
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, n)[here])
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(here), [None, pa.py_buffer(windows)]).dictionary_encode()
            found.append((owner[here], coded.indices.to_numpy() + np.int32(base)))
            words.append(coded.dictionary.cast(pa.binary()))
            base += len(coded.dictionary)
        own = [np.bincount(o, minlength=len(size)) for o, _ in found]
        start = np.append(0, np.cumsum(sum(own, np.zeros(len(size), np.int64))))
        ids, free = np.empty(int(start[-1]), np.int32), start[:-1].copy()
        for (o, i), n in zip(found, own):
            ids[(free - (np.cumsum(n) - n))[o] + np.arange(len(o))] = i
            free += n
        return pa.concat_arrays(words).cast(pa.string()) if words else pa.array([], pa.string()), ids, start

    def counts(self) -> pa.RecordBatch:
        """token, freq over the group's samples."""
        tokens, ids, start = self._listed()
        count, last = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int32)
        if self.p < 1:
            hashes = _token_hash(tokens.to_pylist())
        for codes, key in zip(self.samples, self.keys):
            n = start[codes + 1] - start[codes]
            place = np.arange(int(n.sum()), dtype=np.int32)
            flat = ids[np.repeat(start[codes] - (np.cumsum(n) - n), n) + place]
            last[flat] = place  # of several places of a token one stands for all
            if self.p < 1:
                k = np.bincount(last[flat], minlength=len(flat))
                once = np.flatnonzero(k)
                k, flat = k[once], flat[once]
                flat = flat[_drawn(key, hashes[flat], k, self.p)]
            else:
                flat = flat[last[flat] == place]
            count[flat] += 1
        seen = count > 0
        if self.skip:
            seen &= ~np.asarray(pa.compute.is_in(tokens, pa.array(sorted(self.skip), pa.string())))
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([tokens.take(pa.array(at)), pa.array(count[at])], ["token", "freq"])


def _handed() -> tuple[Column, Column]:
    """A sample's pieces as one string, which goes to Python faster than an array of many, or the array where a text has NUL."""
    plain = F.instr("text", "\0") == 0
    return F.when(plain, F.array_join("pieces", "\0")).alias("joined"), F.when(~plain, F.col("pieces")).alias("pieces")


def _short(samples: DataFrame, max_bytes: int, p: float, skip: frozenset[str]) -> DataFrame:
    """token, freq over samples whose tokens fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Group(max_bytes, skip, p)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = batch.slice(a, ROWS)
                for joined, pieces, key in zip(*(rows.column(k).to_pylist() for k in range(3))):
                    held.add(joined.split("\0") if pieces is None else pieces, key)
                    if held.places > HELD or len(held.samples) > SAMPLES:
                        yield held.counts()
                        held = _Group(max_bytes, skip, p)
        if held.samples:
            yield held.counts()

    return samples.select(*_handed(), "key").mapInArrow(run, "token string, freq long")


def _long(samples: DataFrame, max_bytes: int, p: float, skip: frozenset[str]) -> DataFrame:
    """The same, with the same draws, for samples of any length: a sample's tokens are counted by the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for pieces, nr, key in zip(*(rows.column(k).to_pylist() for k in range(3))):
                for piece in pieces:
                    for some in _windows(piece, max_bytes, 20_000):
                        many = Counter(some)
                        for t in skip & many.keys():
                            del many[t]
                        n = len(many)
                        yield pa.RecordBatch.from_arrays([pa.array([nr] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(list(many), pa.string()), pa.array(list(many.values()), pa.int64())], ["nr", "key", "token", "k"])

    each = samples.select("pieces", F.monotonically_increasing_id().alias("nr"), "key").mapInArrow(run, "nr long, key long, token string, k long")
    each = each.groupBy("nr", "key", "token").agg(F.sum("k").alias("k"))
    if p < 1:
        u = F.xxhash64(F.xxhash64("token").bitwiseXOR(F.col("key"))).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
        each = each.where(u < 1 - F.pow(F.lit(1 - p), F.col("k")))
    return each.groupBy("token").agg(F.count("*").alias("freq"))


def _pieces(split: str | None, p: float) -> Column:
    pieces = F.regexp_extract_all("text", F.lit(mine_regex([split])), F.lit(0)) if split else F.array("text")
    return F.array_distinct(pieces) if split and p >= 1 else pieces  # more of the same changes nothing


def _sample_key(samples: DataFrame, seed: int) -> Column:
    own = [c for c in ("source", "sample_id") if c in samples.columns]
    return F.xxhash64(F.lit(seed), *(own or ["text"]))


def document_frequency(samples: DataFrame, *, max_bytes: int = MAX_BYTES, p: float = PROBABILITY, split: str | None = None, allow: list[str] | None = None, added: list[str] = [], suggested: list[str] = [], seed: int = 0) -> DataFrame:  # noqa: B006
    """token, freq: in how many samples each candidate was drawn, and one more for each time it is added or suggested.

    Each occurrence is drawn with probability ``p``; a sample counts once if
    any of its k occurrences was, so with probability 1 - (1-p)^k.  Candidates
    lie inside matches of ``split`` and must match one of ``allow``; added and
    suggested tokens need neither, and count wherever a sample holds them.
    """
    if not 0 < p <= 1:
        raise ValueError("p lies in (0, 1]")
    listed = frozenset(added) | frozenset(suggested)
    samples = samples.where("text is not null and text <> ''")
    cut = samples.select("text", _pieces(split, p).alias("pieces"), _sample_key(samples, seed).alias("key"), F.length("text").alias("n"))
    # one scan with both kinds would need both outputs; the length decides, so each text is worked on once
    found = _short(cut.where(F.col("n") <= LONG), max_bytes, p, listed).unionAll(_long(cut.where(F.col("n") > LONG), max_bytes, p, listed))
    total = found.groupBy("token").agg(F.sum("freq").alias("freq"))
    if allow:
        total = total.where(F.col("token").rlike(allow_regex(allow)))
    return total.unionAll(listed_frequency(samples, added, suggested, p, seed)) if listed else total


def listed_frequency(samples: DataFrame, added: list[str], suggested: list[str], p: float = 1.0, seed: int = 0) -> DataFrame:
    """token, freq of added and suggested tokens: samples that hold them, and one for each list that names them."""
    spark = samples.sparkSession
    names = Counter(set(added)) + Counter(set(suggested))
    tokens = spark.createDataFrame(sorted(names.items()), "token string, seeds long")
    if sum(map(len, names)) > LISTED_CHARS:
        raise ValueError(f"lists of over {LISTED_CHARS} characters are too large to broadcast")
    shared = spark.sparkContext.broadcast(sorted(t for t in names if t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        few, machine = len(listed) <= FEW, ahocorasick.Automaton()
        for i, t in enumerate(listed):
            machine.add_word(t, i)
        machine.make_automaton()
        hashes, count = _token_hash(listed), np.zeros(len(listed), np.int64)
        for rows in batches:
            for text, key in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                there = (i for i, t in enumerate(listed) if t in text) if few else {i for _, i in machine.iter(text)}
                ids = np.fromiter(there, np.int64)
                if p < 1 and len(ids):
                    ids = ids[_drawn(key, hashes[ids], np.array([text.count(listed[i]) for i in ids.tolist()]), p)]
                count[ids] += 1
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([listed[i] for i in seen.tolist()], pa.string()), pa.array(count[seen])], ["token", "n"])

    texts = samples.where("text is not null and text <> ''").select(F.make_valid_utf8("text"), _sample_key(samples, seed))
    held = (texts.mapInArrow(run, "token string, n long") if shared.value else spark.createDataFrame([], "token string, n long")).groupBy("token").agg(F.sum("n").alias("n"))
    return tokens.join(held, "token", "left").select("token", (F.col("seeds") + F.coalesce("n", F.lit(0))).alias("freq"))


def _batch(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])


_LETTER = r"[^\\^$.\[\](){}*+?|]"
_RANGE = r"[^\[\]\\&~|^-]"
_PLAIN = re.compile(rf"(?:\(\?:|\)(?![?*+{{])|\||(?:{_LETTER}|\.|\[\^?(?:{_RANGE}(?:-{_RANGE})?)+\])(?:[?*+]|\{{[0-9]+(?:,[0-9]*)?\}})?)+")


def _finder(split: str) -> Callable[[str], list[str]] | None:
    """All matches of ``split`` in a text, if it is so plain that Java and Python take it alike: letters, ranges, greedy counts of these, and alternatives."""
    pattern = mine_regex([split]).removeprefix("(?d)")
    try:
        return re.compile(pattern).findall if _PLAIN.fullmatch(pattern) else None
    except re.error:
        return None


def _lists(batches: Iterator[pa.RecordBatch], cut: Callable[[str], list[str]] | None = None) -> Iterator[tuple[Iterable[str], int]]:
    """(the pieces of each sample, their characters at most), from texts that ``cut`` takes apart, or from what ``_handed`` hands on."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            if cut:
                for text in batch.column(0).slice(a, ROWS).to_pylist():
                    yield set(cut(text)), len(text)
                continue
            for joined, pieces in zip(*(batch.slice(a, ROWS).column(k).to_pylist() for k in range(2))):
                yield (joined.split("\0"), len(joined)) if pieces is None else (pieces, sum(map(len, pieces)))


def _piece_counts(batches: Iterator[pa.RecordBatch], cut: Callable[[str], list[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """token, n: the pieces, and how many samples have each."""
    held, chars = Counter(), 0
    for pieces, n in _lists(batches, cut):
        held.update(pieces)
        chars += n
        if len(held) > WORDS or chars > CHARS:
            yield _batch(held)
            held, chars = Counter(), 0
    yield _batch(held)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n: the substrings of at most ``GRAM`` characters of weighted pieces, with the sum of their pieces' weights at least."""
    held: dict[str, int] = {}
    for rows in batches:
        for piece, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            for i in range(len(piece)):
                for j in range(i + 1, min(i + GRAM, len(piece)) + 1):
                    t = piece[i:j]
                    held[t] = held.get(t, 0) + n
                if len(held) > WORDS:
                    yield _batch(held)
                    held = {}
    yield _batch(held)


def _run_counts(grams: frozenset[str], longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for longer substrings, of at most ``longest`` characters, all of whose ``GRAM`` characters in a row are in ``grams``."""
    held: dict[str, int] = {}
    for rows in batches:
        for piece, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            run = 0
            for i in range(len(piece) - GRAM, -1, -1):
                run = run + 1 if piece[i : i + GRAM] in grams else 0
                for j in range(i + GRAM + 1, i + min(GRAM + run - 1, longest) + 1):
                    t = piece[i:j]
                    held[t] = held.get(t, 0) + n
                if len(held) > WORDS:
                    yield _batch(held)
                    held = {}
    yield _batch(held)


class _Node(dict):
    """A beginning of a token: by letter, the longer ones; ``ids`` of the tokens that it ends with, and the longest of the others that it ends with."""

    __slots__ = ("ids", "rest")

    def __init__(self, rest: _Node | None, ids: bytes) -> None:
        self.rest, self.ids = rest, ids

    def __missing__(self, c: str) -> _Node:
        return self if self.rest is None else self.rest[c]


class _Found(dict):
    """By piece, the numbers of the listed tokens inside it, as bytes; they are looked up once for each piece held."""

    def __init__(self, tokens: list[str]) -> None:
        number = {t: array("i", [i]).tobytes() for i, t in enumerate(tokens)}
        nodes = {"": _Node(None, b"")}
        for t in sorted({t[:j] for t in tokens for j in range(1, len(t) + 1)}, key=len):
            before = nodes[t[:-1]]
            rest = before.rest[t[-1]] if len(t) > 1 else before
            before[t[-1]] = nodes[t] = _Node(rest, number.get(t, b"") + rest.ids)
        self.root, self.held = nodes[""], 0

    def __missing__(self, piece: str) -> bytes:
        node, out = self.root, []
        for c in piece:
            node = node[c]
            out.append(node.ids)
        ids = b"".join(out)
        if len(piece) <= MAX_BYTES * 2:
            self[piece] = ids
            self.held += len(ids)
        return ids


def _held_counts(tokens: list[str], batches: Iterator[pa.RecordBatch], cut: Callable[[str], list[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """token, n: how many samples have each of ``tokens`` inside one of their pieces."""
    if not tokens:
        return
    found, count = _Found(tokens), np.zeros(len(tokens), np.int64)
    seen, at = np.zeros((ROWS, len(tokens)), bool), 0
    for pieces, _ in _lists(batches, cut):
        seen[at][np.frombuffer(b"".join([found[piece] for piece in pieces]), np.int32)] = True
        at += 1
        if at == ROWS:
            count += seen.sum(axis=0)
            seen[:], at = False, 0
        if len(found) > WORDS or found.held > CACHED:
            found.clear()
            found.held = 0
    count += seen.sum(axis=0)
    there = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array([tokens[i] for i in there.tolist()], pa.string()), pa.array(count[there])], ["token", "n"])


def top_frequency(samples: DataFrame, k: int, *, max_bytes: int = MAX_BYTES, split: str, allow: list[str] | None = None, added: list[str] = [], suggested: list[str] = []) -> DataFrame:  # noqa: B006
    """``document_frequency`` with p = 1 of one-byte and listed tokens and of all that may be among the first ``k``, of several bytes or in all.

    The counts are exact, and what is left out has proven too few.  A token is in no more samples than
    all pieces around it taken together, and a piece that is a token itself in no fewer than as a piece.  So the
    k-th most frequent of these pieces is a floor, and tokens whose pieces fall short of it can't be among the first.
    The bounds come from the distinct pieces of the corpus; of the samples only the tokens above the floor are counted.
    More than ``BOUND`` of them, and all tokens are counted instead.
    """
    spark, listed = samples.sparkSession, frozenset(added) | frozenset(suggested)
    samples = samples.where("text is not null and text <> ''")
    # Java's matches are slow to make and to hand on, so Python cuts the texts wherever it cuts them alike
    cut = _finder(split)
    handed = samples.select(F.make_valid_utf8("text")) if cut else samples.select("text", _pieces(split, 1.0).alias("pieces")).select(*_handed())
    words = handed.mapInArrow(lambda batches: _piece_counts(batches, cut), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).persist()
    size = F.octet_length("token")
    allowed = F.col("token").rlike(allow_regex(allow)) if allow else F.lit(True)
    whole = lambda: document_frequency(samples, max_bytes=max_bytes, p=1.0, split=split, allow=allow, added=added, suggested=suggested)
    try:
        own = words.where((size > 1) & (size <= max_bytes) & allowed)
        if listed:
            own = own.join(F.broadcast(spark.createDataFrame([(t,) for t in sorted(listed)], "token string")), "token", "left_anti")
        there, least = own.orderBy(F.desc("n")).limit(k).agg(F.count("*"), F.min("n")).first()
        floor = least if there == k > 0 else 1

        def bounded(run: Callable) -> list[str] | None:
            sums = words.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
            rows = sums.where((size <= max_bytes) & ((F.col("n") >= floor) | (size == 1))).select("token", allowed.alias("allowed")).limit(BOUND + 1).collect()
            tokens.extend(r[0] for r in rows if r[1] and r[0] and r[0] not in listed)
            return [r[0] for r in rows] if len(rows) <= BOUND else None

        tokens: list[str] = []
        if (grams := bounded(_gram_counts)) is None:
            return whole()
        shared = spark.sparkContext.broadcast(frozenset(t for t in grams if len(t) == GRAM))
        if bounded(lambda batches: _run_counts(shared.value, max_bytes, batches)) is None:
            return whole()
    finally:
        words.unpersist()
    held = spark.sparkContext.broadcast(sorted(tokens))
    counts = handed.mapInArrow(lambda batches: _held_counts(held.value, batches, cut), "token string, n long").groupBy("token").agg(F.sum("n").alias("freq"))
    return counts.unionAll(listed_frequency(samples, added, suggested)) if listed else counts


def seed_vocabulary(freq: DataFrame, size: int, added: list[str] = [], suggested: list[str] = []) -> DataFrame:  # noqa: B006
    """id, value, score, keep: bytes 0..254, then added and suggested tokens, then the most frequent of several bytes.

    A byte weighs as much as the most frequent token, any other token its
    frequency times its bytes; scores are logs of the weights' shares.
    """
    spark = freq.sparkSession
    ordered = list(dict.fromkeys([*added, *suggested]))
    # a one-byte token is one of the bytes already; 255 can't begin or end UTF-8
    listed = spark.createDataFrame([(t, i, t in set(added)) for i, t in enumerate(t for t in ordered if len(t.encode()) > 1)], "token string, place long, keep boolean")
    room = max(0, size - 255)
    ranked = freq.join(F.broadcast(listed) if len(ordered) <= 100_000 else listed, "token", "left")
    # one pass over the counts: the tokens of one byte, then the listed ones, then the first of the others
    ranked = ranked.orderBy(F.octet_length("token") > 1, F.col("place").asc_nulls_last(), F.desc("freq"), "token").limit(256 + len(ordered) + max(room, 1))
    rows = ranked.select(F.col("token").cast("binary"), "freq", F.coalesce("keep", F.lit(False))).collect()  # of the vocabulary's size
    most = max((n for _, n, _ in rows), default=1)
    top = [(t, n * len(t), keep) for t, n, keep in rows if len(t) > 1][:room]
    weighted = [(bytearray([i]), most, True) for i in range(255)] + top
    return normalised(spark.createDataFrame(weighted, "value binary, weight long, keep boolean"))


def normalised(weighted: DataFrame) -> DataFrame:
    """Scores from weights, ids by score (ties by bytes)."""
    # the vocabulary is bounded by its size, so one partition ranks it
    whole = Window.partitionBy()
    scored = weighted.withColumn("score", F.log(F.col("weight").cast("double")) - F.log(F.sum("weight").over(whole).cast("double")))
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "value")) - 1
    return scored.select(rank.cast("int").alias("id"), "value", "score", "keep")
