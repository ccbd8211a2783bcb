"""Cutting word ranges out of texts, with the other columns of a row kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexloom.llm._text import Words, union_spans


def cut_words(text: str, w: Words, d: int, start: np.ndarray, end: np.ndarray) -> str:
    """``text`` less words start..end of each range, each with what follows up to the next word."""
    lo, hi = w.bounds[d], w.bounds[d + 1]
    ws = np.append(w.start[lo:hi], len(text))
    a, b = union_spans(start, end, hi - lo)
    at, kept = 0, []
    for x, y in zip(ws[a].tolist(), ws[b].tolist()):
        kept.append(text[at:x])
        at = y
    return "".join(kept) + text[at:]


def with_texts(rows: pa.RecordBatch, texts: list, touched: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """``rows`` in ``schema`` with ``texts`` for text, and for n_chars the lengths of the ``touched`` ones."""
    cols = []
    for k, f in enumerate(schema):
        if f.name == "text":
            cols.append(pa.array(texts, f.type))
        elif f.name == "n_chars" and pa.types.is_integer(f.type) and touched:
            sizes = rows.column(k).to_pylist()
            for i in touched:
                sizes[i] = len(texts[i])
            cols.append(pa.array(sizes, f.type))
        else:
            cols.append(rows.column(k))
    return pa.RecordBatch.from_arrays(cols, schema=schema)
