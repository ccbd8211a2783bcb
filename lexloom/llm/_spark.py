"""Small helpers between Spark and the numpy kernels."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute there in a fresh worker)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._text import slices
from lexloom.partitions import spread


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only in local mode a temporary one where that is unset."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        held = spark.conf.get("lexloom.scratch.dir", None)
        if not held:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            held = tempfile.mkdtemp(prefix="lexloom-")
            atexit.register(shutil.rmtree, held, ignore_errors=True)
            spark.conf.set("lexloom.scratch.dir", held)
    return held.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lexloom-{what}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A shared folder's path as the operating system names it (for memory maps); one that isn't mounted is an error."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"memory-mapped files need a folder that is mounted on every executor, not {path!r}")
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage is cut."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions for ``amount`` units of work at ``each`` per task, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(amount / each), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *(F.col(k) for k in keys))


def over_texts(df: DataFrame, text: str, schema: str, fn: Callable[[pa.RecordBatch, list], dict]) -> DataFrame:
    """Apply ``fn(rows, texts) -> columns`` to slices of about 1.5 M characters of ``df``.

    The slices bound a worker's memory by the longest single text, whatever
    the number of rows in an Arrow batch.
    """
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = rows.column(rows.schema.get_field_index(text))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
            for a, b in _slices(sizes):
                part = rows.slice(a, b - a)
                got = fn(part, col.slice(a, b - a).to_pylist())
                if got is not None:
                    yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in out], schema=out)

    return spread(df).mapInArrow(run, schema)


def _slices(sizes: np.ndarray, limit: int = 1_500_000):
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


__all__ = ["by_key", "fresh", "local_path", "over_texts", "parts", "scratch_path", "shared_dir", "slices", "spread", "whole_partition", "written"]
