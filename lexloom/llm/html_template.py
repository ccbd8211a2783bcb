"""HTML extraction by deducing each host's template from token equivalence classes.

Pages of one host are strings of tokens: tags and words.  Tokens whose numbers
of occurrences agree on every page form an equivalence class.  The largest
class of tokens that occur once on at least half of the host's pages is the
skeleton, in the order it has on all of them.  Where the order differs between
pages, the tokens in conflict are taken out, of each page as few as can be and
words before tags; the largest class that is left then, of ``LEAST_CLASS`` tokens
or more, is the skeleton.  Every other class is nested into the one
slot of the skeleton in which it always lies, if its tokens come there in one
order, over and over.  What is left between the template's tokens is the data: one
row for each filled slot and, in a nested class, for each of its turns.

Occurrence vectors are compared by count and by two sums of keyed hashes of
(page, occurrences), so pages of any number are summed in parallel, hot hosts
included.  A first pass names candidates: in each run of pages it counts those
tokens of a host that are on half of its pages there, and bounds the others; what
these sums and bounds leave below half of all the host's pages is out.  The second
pass counts what is left, however the pages of a host are spread.

Defined cases: a page with null or empty html gives no row; a null page_id is an
id like any other; pages with one page_id are pages of their own if their html differs, and count
once if it is the same; a page whose URL has no host belongs to host ""; a host
without a skeleton, and a page that does not follow its host's, give the whole
text as slot -1; an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._spark import over_texts, spread, written
from lexloom.llm.url_filter import split

SUPPORT, LEAST_CLASS, MOST_HELD, BROADCAST_BYTES = 0.5, 3, 200_000, 32_000_000
TOKEN = re.compile(r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^<>]*>|[^\s<>]+|[<>]", re.S | re.I)


def tokens(text: str | None) -> list[str]:
    """Tags (with their attributes), comments, scripts as wholes, and words."""
    return TOKEN.findall(text) if text else []


def plain(toks: list[str]) -> str:
    """The words among ``toks``, with entities resolved; a tag parts words but leaves nothing."""
    return _html.unescape(" ".join(t for t in toks if not (t[0] == "<" and len(t) > 1)))


def host_of(url: str | None) -> str:
    return split(url)[0]


def _key(page: object, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{page}\0{text}")


def template(found: list[tuple[str, int, int, int, int, int]], n_pages: int, support: float, least: int) -> dict | None:
    """The skeleton and the other classes of a host, from (token, pages, occurrences, two sums, sum of first places)."""
    classes: dict[tuple, list] = {}
    for token, pages, n, a, b, place in found:
        if pages >= support * n_pages:
            classes.setdefault((pages, n, a, b), []).append((place, token))
    single = sorted(((pages, len(c), c) for (pages, n, *_), c in classes.items() if pages == n and len(c) >= least), key=lambda x: (-x[0], -x[1], sorted(x[2])))
    if n_pages < 2 or not single:
        return None
    # the sum of places orders tokens as every page does, if all pages agree
    skeleton = [t for _, t in sorted(single[0][2])]
    rest = sorted([t for _, t in sorted(c)] for c in classes.values() if len(c) >= 2 and c is not single[0][2])
    at = {c[0]: i for i, c in enumerate(rest)}
    others = [(pages, at[min(c)[1]]) for pages, _, c in single[1:]] if least >= 2 else []
    return {"skeleton": skeleton, "nested": rest, "pages": single[0][0], "others": others}


def in_order(ranks: list[int], weights: list[int]) -> set[int]:
    """The heaviest ascending subsequence of distinct ``ranks`` within 0..n-1."""
    n = len(ranks)
    tree, before = [(0, -1)] * (n + 1), {}
    for r in ranks:
        best, k = (0, -1), r
        while k > 0:
            best, k = max(best, tree[k]), k & (k - 1)
        before[r] = best[1]
        best, k = (best[0] + weights[r], r), r + 1
        while k <= n:
            tree[k], k = max(tree[k], best), k + (k & -k)
    r, k = (0, -1), n
    while k > 0:
        r, k = max(r, tree[k]), k & (k - 1)
    kept, r = set(), r[1]
    while r >= 0:
        kept.add(r)
        r = before[r]
    return kept


def conflicts(toks: list[str], t: dict) -> list[tuple[int, int]]:
    """(class, token) of what must go for this page's order to be that of the draft; class -1 is the skeleton."""
    out = []
    for c, names in [(-1, t["skeleton"]), *((c, t["nested"][c]) for _, c in t["others"])]:
        rank = {name: k for k, name in enumerate(names)}
        here = [rank[tok] for tok in toks if tok in rank]
        if sorted(here) == list(range(len(names))) != here:
            kept = in_order(here, [len(names) + 1 if name[0] == "<" and len(name) > 1 else 1 for name in names])
            out += [(c, k) for k in here if k not in kept]
    return out


def mended(t: dict, gone: set[tuple[int, int]], least: int) -> dict | None:
    """The draft with the largest class that is left without its tokens in conflict."""
    classes = [(t["pages"], -1, t["skeleton"]), *((pages, c, t["nested"][c]) for pages, c in t["others"])]
    left = [(pages, c, [name for k, name in enumerate(names) if (c, k) not in gone]) for pages, c, names in classes]
    left = sorted((x for x in left if len(x[2]) >= least), key=lambda x: (-x[0], -len(x[2]), x[2]))
    if not left:
        return None
    pages, chosen, skeleton = left[0]
    rest = [names for c, names in enumerate(t["nested"]) if c != chosen] + ([t["skeleton"]] if chosen >= 0 else [])
    return {"skeleton": skeleton, "nested": sorted(rest), "pages": pages, "others": []}


def places(toks: list[str], skeleton: list[str]) -> list[int] | None:
    """Where the skeleton's tokens stand, if the page has each once and in order."""
    rank = {t: i for i, t in enumerate(skeleton)}
    at = [(i, rank[t]) for i, t in enumerate(toks) if t in rank]
    return [i for i, _ in at] if [r for _, r in at] == list(range(len(skeleton))) else None


def check_page(toks: list[str], t: dict) -> list[tuple[int, int, int, int]]:
    """(class, first slot, last slot, faults) for the skeleton (-1) and each nested class on this page."""
    at = places(toks, t["skeleton"])
    if at is None:
        return [(-1, 0, 0, int(set(t["skeleton"]) <= set(toks)))]
    kind = {tok: (c, k) for c, names in enumerate(t["nested"]) for k, tok in enumerate(names)}
    slots: dict[int, list[int]] = {}
    turn: Counter = Counter()
    bad: Counter = Counter()
    edge = 0
    for i, tok in enumerate(toks):
        while edge < len(at) and at[edge] <= i:
            edge += 1
        if tok in kind:
            c, k = kind[tok]
            lo_hi = slots.setdefault(c, [edge, edge])
            lo_hi[0], lo_hi[1] = min(lo_hi[0], edge), max(lo_hi[1], edge)
            bad[c] += turn[c] % len(t["nested"][c]) != k
            turn[c] += 1
    return [(c, lo, hi, int(bad[c] > 0)) for c, (lo, hi) in slots.items()] + [(-1, 0, 0, 0)]


def extract(toks: list[str], t: dict | None) -> list[tuple[int, int, str]]:
    """(slot, turn, text) of the data on a page; slot k lies before the skeleton's token k."""
    at = places(toks, t["skeleton"]) if t else None
    if at is None:
        text = plain(toks)
        return [(-1, 0, text)] if text else []
    marks: dict[int, dict[str, bool]] = {}
    for c, names in enumerate(t["nested"]):
        for k, name in enumerate(names):
            marks.setdefault(t["slots"][c], {})[name] = k == 0
    out = []
    for slot, (a, b) in enumerate(zip([-1, *at], [*at, len(toks)])):
        mark, turn, held = marks.get(slot, {}), 0, []
        for tok in toks[a + 1 : b]:
            if tok in mark:
                if mark[tok] or held:
                    if text := plain(held):
                        out.append((slot, turn, text))
                    held = []
                    turn += mark[tok]
            else:
                held.append(tok)
        if text := plain(held):
            out.append((slot, turn, text))
    return out


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST_CLASS) -> DataFrame:
    """(host, template): each host's valid template as JSON."""
    pages = pages.select("page_id", "url", "html").where("html is not null and html <> ''")

    once = pages.dropDuplicates() if _has_repeats(pages) else pages

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        size: Counter = Counter()

        def flush() -> pa.RecordBatch:
            # a token that isn't named here is on at most ``rest`` of the host's pages here
            rest = {h: math.ceil(support * n) - 1 for h, n in size.items()}
            rows = [(h, t, n, rest[h]) for h, c in seen.items() for t, n in [("\0", size[h]), *c.items()] if n > rest[h]]
            seen.clear(), size.clear()
            return pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "token", "n", "rest"])

        for rows in batches:
            for url, text in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                host = host_of(url)
                seen.setdefault(host, Counter()).update(set(tokens(text)))
                size[host] += 1
                if sum(map(len, seen.values())) > MOST_HELD:
                    yield flush()
        yield flush()

    named = spread(once).mapInArrow(name, "host string, token string, n long, rest long").groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))
    named = written(named, "named")
    whole = named.where(F.col("token") == "\0").select("host", F.col("n").alias("pages"), F.col("rest").alias("most"))
    able = named.where(F.col("token") != "\0").join(whole, "host").where(F.col("n") + F.col("most") - F.col("rest") >= support * F.col("pages"))
    asked = written(able.groupBy("host").agg(F.collect_list("token").alias("t")), "candidates")

    def count(rows: list[tuple], of: Callable[[str], object]) -> dict:
        out: dict[tuple[str, str], list[int]] = {}
        for page, url, text in rows:
            host, key, toks = host_of(url), None, tokens(text)
            want = of(host) or ()
            got: dict[str, list[int]] = {}
            for i, tok in enumerate(toks):
                if tok in want:
                    got.setdefault(tok, [0, i])[0] += 1
            key = _key(page, text)
            got["\0"] = [1, 0]  # the page itself
            for tok, (n, place) in got.items():
                h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=n)
                x = out.setdefault((host, tok), [0] * 5)
                for k, v in enumerate((1, n, h & 0x3FFFFFFF, h >> 34, place)):
                    x[k] += v
        return {"host": [h for h, _ in out], "token": [t for _, t in out], **{c: [x[k] for x in out.values()] for k, c in enumerate(("pages", "n", "a", "b", "place"))}}

    counts = _with(once, asked, lambda v: frozenset(v), count, "host string, token string, pages long, n long, a long, b long, place long")
    counts = counts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "a", "b", "place")))
    # what reaches a host's task are tokens on ``support`` of its pages, of which a page has only so many
    of = whole.select(F.col("host").alias("of_host"), F.col("pages").alias("of_pages"))
    counts = counts.join(of, counts["host"] == of["of_host"]).where((F.col("token") == "\0") | (F.col("pages") >= support * F.col("of_pages"))).select(*counts.columns)

    def deduce(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("token", "pages", "n", "a", "b", "place"))))
        n_pages = next(r[1] for r in rows if r[0] == "\0")
        found = template([r for r in rows if r[0] != "\0"], n_pages, support, least)
        return pa.table({"host": t.column("host").slice(0, 1), "t": pa.array([json.dumps(found)] if found else [None], pa.string())})

    drafts = written(counts.groupBy("host").applyInArrow(deduce, "host string, t string").where("t is not null"), "drafts")

    def check(rows: list[tuple], of: Callable[[str], object]) -> dict:
        out: dict[tuple[str, int], list[int]] = {}
        for _, url, text in rows:
            host = host_of(url)
            t = of(host)
            for c, lo, hi, bad in check_page(tokens(text), t) if t else ():
                x = out.setdefault((host, c), [lo, hi, 0])
                x[0], x[1], x[2] = min(x[0], lo), max(x[1], hi), x[2] + bad
        return {"host": [h for h, _ in out], "c": [c for _, c in out], **{n: [x[k] for x in out.values()] for k, n in enumerate(("lo", "hi", "bad"))}}

    def checked(drafts: DataFrame) -> DataFrame:
        found = _with(pages, drafts, json.loads, check, "host string, c int, lo int, hi int, bad long").groupBy("host", "c")
        found = found.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bad").alias("bad"))
        good = found.groupBy("host").agg(F.collect_list(F.struct("c", "lo", "hi", "bad")).alias("v"))
        return written(drafts.join(good, "host").select("host", "t", "v"), "checked")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hosts, out = [], []
            for host, t, v in zip(*(rows.column(i).to_pylist() for i in range(3))):
                t, v = json.loads(t), {x["c"]: x for x in v}
                if v.get(-1, {"bad": 1})["bad"]:
                    continue
                fit = [c for c in range(len(t["nested"])) if c in v and not v[c]["bad"] and v[c]["lo"] == v[c]["hi"]]
                hosts.append(host)
                out.append(json.dumps({"skeleton": t["skeleton"], "nested": [t["nested"][c] for c in fit], "slots": [v[c]["lo"] for c in fit]}))
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(out, pa.string())], ["host", "template"])

    def order(rows: list[tuple], of: Callable[[str], object]) -> dict:
        out = set()
        for _, url, text in rows:
            host = host_of(url)
            t = of(host)
            out.update((host, *x) for x in conflicts(tokens(text), t)) if t else None
        return {n: [x[k] for x in out] for k, n in enumerate(("host", "c", "k"))}

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [(host, mended(json.loads(t), {(x["c"], x["k"]) for x in gone or ()}, least)) for host, t, gone in zip(*(rows.column(i).to_pylist() for i in range(3)))]
            got = [(host, json.dumps(t)) for host, t in got if t]
            yield pa.record_batch([pa.array([h for h, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], ["host", "t"])

    done = checked(drafts)
    faulty = done.where(F.exists("v", lambda x: (x["c"] == -1) & (x["bad"] > 0))).select("host", "t")
    if faulty.limit(1).count():
        gone = _with(pages, faulty, json.loads, order, "host string, c int, k int").distinct().groupBy(F.col("host").alias("of")).agg(F.collect_list(F.struct("c", "k")).alias("gone"))
        again = faulty.join(gone, faulty["host"] == gone["of"], "left").select("host", "t", "gone")
        done = done.unionAll(checked(written(again.mapInArrow(mend, "host string, t string"), "mended")))
    return done.mapInArrow(settle, "host string, template string")


def _has_repeats(pages: DataFrame) -> bool:
    keys = pages.select(F.xxhash64("page_id", "url", "html").alias("k"))
    return bool(keys.groupBy("k").count().where("count > 1").limit(1).count())


def _with(pages: DataFrame, by_host: DataFrame, parse: Callable, fn: Callable, schema: str) -> DataFrame:
    """fn(rows, host -> parsed value) over the pages; the values are broadcast while they are small, and joined by host otherwise."""
    value = by_host.columns[1]
    size = by_host.agg(F.sum(F.length(F.to_json(F.struct(value))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({h: parse(v) for h, v in by_host.collect()})
        return over_texts(pages, "html", schema, lambda rows, texts: fn(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts)), held.value.get))

    def host(rows: pa.RecordBatch, texts: list) -> dict:
        return {"page_id": rows.column(0), "url": rows.column(1), "html": texts, "h": [host_of(u) for u in rows.column(1).to_pylist()]}

    wide = over_texts(pages, "html", "page_id long, url string, html string, h string", host)
    both = wide.join(by_host, wide["h"] == by_host["host"], "left").select("page_id", "url", "html", "h", value)

    def run(rows: pa.RecordBatch, texts: list) -> dict:
        values = {h: parse(v) for h, v in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist()) if v is not None}
        return fn(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts)), values.get)

    return over_texts(both, "html", schema, run)


def extracted(pages: DataFrame, support: float = SUPPORT, least: int = LEAST_CLASS) -> DataFrame:
    """(page_id, host, slot, turn, text): the data of every page."""
    found = written(templates(pages, support, least), "templates")
    pages = pages.select("page_id", "url", "html").where("html is not null and html <> ''")

    def fn(rows: list[tuple], of: Callable[[str], object]) -> dict:
        cols: dict[str, list] = {c: [] for c in ("page_id", "host", "slot", "turn", "text")}
        for page, url, text in rows:
            host = host_of(url)
            for got in extract(tokens(text), of(host)):
                for c, v in zip(cols, (page, host, *got)):
                    cols[c].append(v)
        return cols

    return _with(pages, found, json.loads, fn, "page_id long, host string, slot int, turn int, text string")
