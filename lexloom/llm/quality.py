"""Quality rule: repetition inside a document, by suffix array.

The words of a document are sorted by suffix.  A suffix and its neighbour with
longest common prefix l >= ``min_repeat`` are the border of an LCP interval,
i.e. of a right-maximal repeated substring; the spans of all of them are
united (the left-maximal ones contain the rest).  A document goes if the
repeats cover more than ``max_covered`` of its words, or if its longest repeat
has more than ``max_longest`` words.

Defined cases: a null, empty or wordless text has 0 words, 0.0 covered and is
kept; overlapping repeats count ("a a a a" repeats "a a a"); every row is
judged by itself, so repeated rows and null ids change nothing; extra columns
are ignored (``rejects``) or passed through (``kept``); an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm._spark import _slices, over_texts, spread
from lexloom.llm._suffix import lcp_array, suffix_array
from lexloom.llm._text import U64, mix64, segment_sums, words

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.5, 100


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, covered words, longest repeat in words) of every text."""
    w = words(texts)
    n = np.diff(w.bounds)
    if not len(w.hash):
        return n, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    # the document's number in the symbol keeps repeats within one document
    sa, levels = suffix_array(w.hash ^ mix64(w.doc.astype(U64) + U64(1)))
    lcp = lcp_array(sa, levels, min_repeat)
    reach = np.empty(len(sa), np.int64)
    reach[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    reach[reach < min_repeat] = 0
    at = np.flatnonzero(reach)
    depth = np.zeros(len(sa) + 1, np.int64)
    depth[at] += 1
    np.subtract.at(depth, at + reach[at], 1)
    covered = segment_sums(np.cumsum(depth[:-1]) > 0, w.bounds)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, w.doc[at], reach[at])
    return n, covered, longest


def judge(texts: list[str | None], min_repeat: int, max_covered: float, max_longest: int) -> dict:
    n, covered, longest = measure(texts, min_repeat)
    share = covered / np.maximum(n, 1)
    return {"n_words": n, "covered": share, "longest_repeat": longest, "keep": (share <= max_covered) & (longest <= max_longest)}


def repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, n_words, covered, longest_repeat and the decision ``keep`` of every document."""

    def fn(rows: pa.RecordBatch, texts: list) -> dict:
        return {"doc_id": rows.column(0), **judge(texts, min_repeat, max_covered, max_longest)}

    return over_texts(docs.select("doc_id", "text"), "text", "doc_id long, n_words long, covered double, longest_repeat long, keep boolean", fn)


def kept(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that the rule keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = rows.column(at)
            for a, b in _slices(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))):
                part = rows.slice(a, b - a)
                yield part.filter(pa.array(judge(part.column(at).to_pylist(), min_repeat, max_covered, max_longest)["keep"]))

    return spread(docs).mapInArrow(run, docs.schema)
