"""Spreading small inputs over the cores, and batches over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

SLICE = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is a plain scan of fewer splits than there are cores.

    A file of one row group is one task, however many cores there are.  Inputs of
    more splits, and whatever has been shuffled before, stay as they are, so
    nothing large is moved.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in (text := plan.executedPlan().toString()) or "AdaptiveSparkPlan" in text or "Scan" not in text:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def sliced(rows: pa.Array | pa.RecordBatch, sizes: pa.Array) -> Iterator:
    """``rows`` in slices of about ``SLICE`` bytes or ids by their ``sizes``: a worker's memory follows from the longest single row, not from a batch."""
    at, held = 0, 0
    for i, n in enumerate(np.asarray(pa.compute.fill_null(sizes, 0)).tolist()):
        if i > at and held + n > SLICE:
            yield rows.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(rows):
        yield rows.slice(at)


def by_bytes(texts: pa.Array) -> Iterator[pa.Array]:
    return sliced(texts, pa.compute.binary_length(texts))
