"""Column expressions: processors, digamma, text measures."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.tokenizer import FORMS, PROCESSORS
from lexloom.partitions import by_bytes


def crlf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def normal_form(text: Column, form: str) -> Column:
    """Unicode normal form ``form``; Spark has no function for it, so an Arrow UDF over whole batches."""
    name = form.upper()

    @F.arrow_udf("string")
    def normalised(s: pa.Array) -> pa.Array:
        each = [pa.array([t if t is None or t.isascii() else unicodedata.normalize(name, t) for t in some.to_pylist()], pa.string()) for some in by_bytes(s)]
        return pa.concat_arrays(each) if each else pa.array([], pa.string())

    return normalised(text)


def processor(name: str, text: Column) -> Column:
    if name not in PROCESSORS:
        raise ValueError(f"no processor is called {name}; there are {', '.join(PROCESSORS)}")
    return normal_form(text, name) if name in FORMS else crlf(text)


def processors(names: list[str], text: Column) -> Column:
    """All of ``names`` in order."""
    return reduce(lambda c, n: processor(n, c), names, text)


def digamma(x: Column) -> Column:
    """digamma for x >= 0.5, within codegen: at most seven steps of the recurrence, then the series."""
    below = sum((F.when(x + i < 7, 1 / (x + i)).otherwise(0.0) for i in range(7)), F.lit(0.0))
    at = x + F.greatest(F.ceil(7 - x), F.lit(0))
    y = at - 0.5
    u = 1 / (y * y)
    series = u * (1 / 24 + u * (-7 / 960 + u * (31 / 8064 - u * (127 / 30720))))
    return F.log(y) + series - below


def occurrences(text: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty ``needle``."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")
