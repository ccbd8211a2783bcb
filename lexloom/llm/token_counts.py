"""Token counts by section, from one encoding of the whole document.

The document is encoded once; every token has the span of characters that its
bytes touch.  Sections are the document's lines, each with its line feed, so
they tile the text.  The tokens' spans are joined to the sections' spans, and
a token that crosses a boundary is allocated by the rule: ``start`` gives it to
the section of its first character, ``majority`` to the section with most of
its characters (the earliest of equals), ``fraction`` to each section by its
share of the token's characters.  The counts of a document's sections therefore
sum to the count of the document.

Defined cases: a null or empty text has no section and gives no row; an empty
line is a section of one line feed; rows with a null or repeated doc_id are
counted each for itself; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm._bpe import TOKENIZER, chunks
from lexloom.llm._spark import over_texts

RULES = ("start", "majority", "fraction")


def allocate(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section edges[i]:edges[i+1], for token spans start:end inside edges[0]:edges[-1]."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(edges) - 1
    a = np.searchsorted(edges, start, "right") - 1
    z = np.searchsorted(edges, end - 1, "right") - 1
    cross = np.flatnonzero(a != z)
    inner = a == z
    tokens = np.bincount(a[inner], minlength=n).astype(float)
    size = (z - a + 1)[cross]
    first = np.cumsum(size) - size
    of = np.repeat(cross, size)
    section = np.arange(len(of)) - np.repeat(first, size) + a[of]
    share = np.minimum(end[of], edges[section + 1]) - np.maximum(start[of], edges[section])
    if rule == "start":
        tokens += np.bincount(a[cross], minlength=n)
    elif rule == "fraction":
        tokens += np.bincount(section, share / (end - start)[of], minlength=n)
    elif len(cross):
        best = np.maximum.reduceat(share, first)
        is_best = np.flatnonzero(share == np.repeat(best, size))
        lead = np.unique(of[is_best], return_index=True)[1]
        tokens += np.bincount(section[is_best[lead]], minlength=n)
    return tokens, np.bincount(section, minlength=n)


def _count(texts: list[str | None], rule: str, tokenizer: str) -> dict:
    texts = [t or "" for t in texts]
    tok = chunks(tokenizer)
    ids, _ = tok.encode(texts)
    raw = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that a byte belongs to
    ends = np.cumsum(tok.size_of[ids])
    start, end = char[ends - tok.size_of[ids]] if len(ids) else ends, char[ends - 1] + 1 if len(ids) else ends
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.append(0, np.cumsum(size))
    edges = np.unique(np.concatenate([base, char[np.flatnonzero(raw == 10)] + 1]))
    tokens, crossing = allocate(start, end, edges, rule)
    lo = edges[:-1]
    doc = np.searchsorted(base, lo, "right") - 1
    return {"row": doc, "section": np.arange(len(lo)) - np.searchsorted(lo, base[doc]), "start_char": lo - base[doc], "end_char": edges[1:] - base[doc], "n_tokens": tokens, "n_crossing": crossing}


def section_tokens(docs: DataFrame, rule: str = "majority", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens and n_crossing (tokens that reach over a boundary) of every section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def fn(rows: pa.RecordBatch, texts: list) -> dict:
        got = _count(texts, rule, tokenizer)
        return {"doc_id": rows.column(0).take(pa.array(got.pop("row"))), **got}

    return over_texts(docs.select("doc_id", "text"), "text", "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long", fn)
