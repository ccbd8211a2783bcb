"""URL filter by a sorted, memory-mapped array of 64-bit xxhash digests.

An entry is a host, which blocks the host and all hosts under it, or a host and
a path, which blocks that path and all that lies under it.  Entries are
normalised, digested, split by the top bits of the digest and written as sorted
arrays with their strings.  A URL asks for its path and each parent path, then
for its host and each parent domain; the batch's digests are probed by one
vectorised binary search, and a hit counts only if the stored string is equal.

Defined cases: a null, empty or hostless URL is not blocked; scheme, user, port,
fragment, letter case of the host and a leading "www." make no difference;
null and empty entries are left out and repeated ones count once; a file of the
array that is gone is an error, never an empty list; of several
entries that match, the longest is named; rows are judged each for itself, and an empty
table or an empty list gives what one expects.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _eliasfano as ef
from lexloom.llm._spark import local_path, over_texts, scratch_path

#: The registered query's list: these hosts, HOSTS more that are made up, and as many paths of one host.
BLOCKED = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.com", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org", "ads-track.example.org", "adult-x.example.net", "casino-win.example.com", "casino-win.example.org", "free-bets.example.com", "spam-farm.example.com")
HOSTS, PREFIX = 600_000, "thther.example.org/en/"
PER_FILE = 500_000


def split(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL, normalised; ("", "") if it has no host."""
    if not url:
        return "", ""
    rest = url.strip()
    if "://" in rest:
        rest = rest.split("://", 1)[1]
    rest = rest.removeprefix("//").split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = host.rsplit("@", 1)[-1].lower()
    if not host.startswith("["):
        host = host.split(":", 1)[0]
    host = host.rstrip(".").removeprefix("www.")
    return (host, path.rstrip("/")) if host else ("", "")


def probes(url: str | None) -> list[str]:
    """All entries that would block ``url``, longest first."""
    host, path = split(url)
    if not host:
        return []
    out = []
    if path:
        out.append(host + path)
        cuts = [i for i, c in enumerate(path) if i and c in "/?"]
        out += [host + path[:i].rstrip("/") for i in reversed(cuts)]
    while host:
        out.append(host)
        host = host.partition(".")[2]
    return list(dict.fromkeys(out))


class DigestArray:
    """The entries' files: digests ascending, and the strings they stand for."""

    def __init__(self, path: str, bits: int, parts: set[int]) -> None:
        self.path, self.bits, self.parts = path, bits, parts
        self._open: dict[int, list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "bits": self.bits, "parts": self.parts, "_open": {}}

    def part(self, k: int) -> list[np.ndarray]:
        if k not in self._open:
            self._open[k] = ef.load(f"{self.path}/urls-{k}") if k in self.parts else [np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint8)]
        return self._open[k]

    def contains(self, asked: list[str]) -> np.ndarray:
        """Which of ``asked`` are entries."""
        digest = np.array([xxhash.xxh64_intdigest(s) for s in asked], np.uint64)
        top = (digest >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(asked), np.int64)
        found = np.zeros(len(asked), bool)
        for k in np.unique(top).tolist():
            keys, at, text = self.part(k)
            mine = np.flatnonzero(top == k)
            i = np.searchsorted(keys, digest[mine])
            live = np.flatnonzero(i < len(keys))
            live = live[keys[i[live]] == digest[mine[live]]]
            for q, j in zip(mine[live].tolist(), i[live].tolist()):
                while j < len(keys) and keys[j] == digest[q] and not found[q]:  # one digest may stand for several strings
                    found[q] = text[at[j] : at[j + 1]].tobytes() == asked[q].encode()
                    j += 1
        return found


def write_part(path: str, k: int, entries: list[str]) -> None:
    raw = [e.encode() for e in entries]
    digest = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
    o = np.argsort(digest, kind="stable")
    raw = [raw[i] for i in o.tolist()]
    ef.save(f"{path}/urls-{k}", [digest[o], np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)])


def entry(text: str | None) -> str:
    return "".join(split(text))


def digest_array(spark: SparkSession, entries: DataFrame | Iterable[str]) -> DigestArray:
    """Files for ``entries``: strings, or a table whose first column has them, of any size."""
    path = local_path(scratch_path(spark, "urls"))
    if not isinstance(entries, DataFrame):
        write_part(path, 0, sorted({e for e in map(entry, entries) if e}))
        return DigestArray(path, 0, {0})
    entries = entries.toDF("entry", *(f"c{i}" for i in range(1, len(entries.columns)))).select("entry")
    bits = max(0, (entries.count() // PER_FILE).bit_length())

    def digest(rows: pa.RecordBatch, texts: list) -> dict:
        kept = [e for e in map(entry, texts) if e]
        return {"k": [xxhash.xxh64_intdigest(e) >> (64 - bits) if bits else 0 for e in kept], "entry": kept}

    def save(t: pa.Table) -> pa.Table:
        k = t.column("k")[0].as_py()
        write_part(path, k, sorted(set(t.column("entry").to_pylist())))
        return pa.table({"k": pa.array([k], pa.int64())})

    made = over_texts(entries, "entry", "k long, entry string", digest).distinct().groupBy("k").applyInArrow(save, "k long").collect()
    return DigestArray(path, bits, {r[0] for r in made})


def block_list(spark: SparkSession) -> DataFrame:
    """The registered query's list of hosts and paths, as a table."""
    made = [F.concat(F.lit("site"), "id", F.lit(".blocked.example")), F.concat(F.lit(PREFIX), "id")]
    found = spark.createDataFrame([(b,) for b in BLOCKED], "entry string")
    for m in made:
        found = found.unionAll(spark.range(HOSTS).select(m.alias("entry")))
    return found


def filtered(pages: DataFrame, entries: DataFrame | Iterable[str] = BLOCKED) -> DataFrame:
    """(page_id, url, blocked, entry) of every page; entry is the longest that matches."""
    table = digest_array(pages.sparkSession, entries)

    def fn(rows: pa.RecordBatch, urls: list) -> dict:
        each = [probes(u) for u in urls]
        size = np.array([len(e) for e in each], np.int64)
        asked = [p for e in each for p in e]
        places = {p: i for i, p in enumerate(dict.fromkeys(asked))}
        held = table.contains(list(places))
        names = [next((p for p in e if held[places[p]]), None) for e in each] if size.any() else [None] * len(urls)
        return {"page_id": rows.column(0), "url": rows.column(1), "blocked": [n is not None for n in names], "entry": names}

    return over_texts(pages.select("page_id", "url"), "url", "page_id long, url string, blocked boolean, entry string", fn)


def oracle() -> str:
    """The registered query in SQL: a URL's host and its parents, and its paths, are looked up among the entries."""
    rows = ", ".join(f"('{e}')" for e in BLOCKED)
    return f"""
WITH b AS (SELECT * FROM (VALUES {rows}) v(e) UNION ALL SELECT 'site' || i || '.blocked.example' FROM range({HOSTS}) r(i) UNION ALL SELECT '{PREFIX}' || i FROM range({HOSTS}) r(i)),
p AS (SELECT page_id, url, regexp_replace(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '^www[.]', '') AS h,
      regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:]+://[^/?]+(.*)$', 1) AS path FROM pages),
asked AS (SELECT page_id, url, array_to_string(string_split(h, '.')[i:], '.') AS q FROM (SELECT *, unnest(range(1, len(string_split(h, '.')) + 1)) AS i FROM p)
      UNION ALL SELECT page_id, url, h || rtrim(path[1:i], '/') FROM (SELECT *, unnest(range(1, length(path) + 1)) AS i FROM p) WHERE i = length(path) OR path[i + 1] IN ('/', '?')),
m AS (SELECT page_id, url, max_by(e, length(e)) AS entry FROM asked JOIN b ON q = e GROUP BY page_id, url)
SELECT page_id, url, entry IS NOT NULL AS blocked, entry FROM p LEFT JOIN m USING (page_id, url)"""
