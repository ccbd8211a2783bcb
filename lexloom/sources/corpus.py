"""Reading and writing: corpora of NUL-separated samples, token lists, patterns, tokenizers."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import columns
from lexloom.functions.patterns import NAMED, java
from lexloom.functions.tokenizer import Token

VOCAB = "id int, value binary, score double, keep boolean"


def parse_spec(spec: str) -> tuple[str, str, float]:
    """``name:path[:proportion]``."""
    parts = spec.split(":")
    if len(parts) not in (2, 3):
        raise ValueError(f"a source is name:path[:proportion], not {spec!r}")
    share = float(parts[2]) if len(parts) == 3 else 1.0
    if not 0 <= share <= 1:
        raise ValueError(f"a proportion lies in 0..1, not {share}")
    return parts[0], parts[1], share


def read_samples(spark: SparkSession, path: str, source: str) -> DataFrame:
    """source, sample_id, text of a NUL-separated file; empty samples are left out, bad UTF-8 is an error."""
    raw = spark.read.option("lineSep", "\0").text(path)
    # samples count in the order of the files' names, and of their places within: a split's first byte and the row in it
    names = spark.createDataFrame([(re.sub("^file:/+", "/", f), k) for k, f in enumerate(sorted(raw.inputFiles()))], "file string, nr long")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = raw.select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), (F.col("_metadata.file_block_start") + row).alias("at"))
    raw = raw.join(F.broadcast(names), "file").select("value", (F.col("nr") * (1 << 40) + F.col("at")).alias("sample_id"))
    bad = F.raise_error(F.concat(F.lit(f"{path}: sample "), F.col("sample_id").cast("string"), F.lit(" isn't UTF-8")))
    text = F.when(F.expr("is_valid_utf8(value)"), F.col("value")).otherwise(bad.cast("string"))
    return raw.select(F.lit(source).alias("source"), "sample_id", text.alias("text")).where("text <> ''")


def write_samples(texts: DataFrame, path: str) -> None:
    """The column text as NUL-separated files; a text that holds a NUL is an error."""
    safe = F.when(F.instr("text", "\0") == 0, F.col("text")).otherwise(F.raise_error(F.lit("a sample holds a NUL")).cast("string"))
    texts.where("text <> ''").select(safe.alias("value")).write.option("lineSep", "\0").text(path)


def prefix_sample(samples: DataFrame, proportion: float, order: str = "sample_id") -> DataFrame:
    """The first floor(n * proportion) samples of every source."""
    return samples if proportion >= 1 else before_limits(samples, order, F.lit(1), {"kept": lambda n: F.floor(n * proportion)}).where("kept").drop("kept")


STRIDE = 1_000_000


def before_limits(samples: DataFrame, order: str, weight: Column, limits: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each limit a column: whether the weights of the source's samples before this one are under it.

    Limits are functions of the source's total.  Texts stay where they are: sums
    over stretches of ``STRIDE`` ids find the stretch in which a source crosses a
    limit, and only that stretch's ids are ranked; what comes back is one row
    for each source and limit.  Samples of one id come in the order of their text's hash.
    """
    keys = samples.select("source", F.col(order).alias("o"), weight.cast("long").alias("w"), F.floor(F.col(order) / STRIDE).alias("b"), F.xxhash64("text").alias("h"))
    sums = keys.groupBy("source", "b").agg(F.sum("w").alias("s"))
    by = Window.partitionBy("source")
    start = F.coalesce(F.sum("s").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"start": start, "total": F.sum("s").over(by)})
    out, own = samples.withColumn("__h", F.xxhash64("text")), samples.columns
    for name, limit in limits.items():
        each = sums.withColumn("limit", limit(F.col("total")))
        crossing = each.where("start < limit and start + s >= limit").select(F.col("source").alias("of"), F.col("b").alias("at"), "start", "limit")
        ranked = keys.join(F.broadcast(crossing), F.col("source").eqNullSafe(F.col("of")) & (F.col("b") == F.col("at")))
        before = F.col("start") + F.coalesce(F.sum("w").over(by.orderBy("o", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = ranked.withColumn("before", before).where("before < limit").groupBy("of").agg(F.max(F.struct("o", "h")).alias("last"))
        whole = each.groupBy("source").agg(F.max(F.col("limit") > F.col("total")).alias("whole"))
        cut = whole.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("__source"), "whole", "last")
        out = out.join(F.broadcast(cut), out["source"].eqNullSafe(cut["__source"]), "left")
        inside = F.coalesce(F.col("whole") | (F.struct(F.col(order), F.col("__h")) <= F.col("last")), F.lit(False))
        own = [*own, name]
        out = out.withColumn(name, inside).select(*own, "__h")
    return out.drop("__h")


def shuffled(samples: DataFrame, seed: int = 0) -> DataFrame:
    """The samples in a random order that depends on the seed and the rows alone."""
    key = F.xxhash64(F.lit(seed), *samples.columns)
    return samples.withColumn("__k", key).orderBy("__k").drop("__k")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, and only in local mode a temporary one where that is unset."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if held:
        return f"{held.rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lexloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{made}/data"


def processed(samples: DataFrame, names: list[str]) -> DataFrame:
    """Texts after the processors; those that become empty go."""
    return samples.withColumn("text", columns.processors(names, F.col("text"))).where("text <> ''") if names else samples


def load(spark: SparkSession, specs: Iterable[str], processors: list[str] = []) -> DataFrame:  # noqa: B006
    """Every source of ``specs``: sampled, then processed."""
    each = [prefix_sample(read_samples(spark, path, name), share) for name, path, share in map(parse_spec, specs)]
    if not each:
        raise ValueError("no source is given")
    return processed(reduce(DataFrame.unionByName, each), processors)


def totals(samples: DataFrame) -> DataFrame:
    """Samples, bytes, characters and MB (of a million bytes) of every source."""
    sums = samples.groupBy("source").agg(F.count("*").alias("samples"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.char_length("text")).alias("chars"))
    return sums.withColumn("mb", F.round(F.col("bytes") / 1e6, 2))


def read_pattern(path: str) -> str:
    """A pattern file: line ends don't count, nor does space around the whole."""
    return Path(path).read_text(encoding="utf-8").replace("\n", "").replace("\r", "").strip()


def pattern(name_or_path: str) -> str:
    """A named pattern, else the one in the file."""
    return java(name_or_path) if name_or_path in NAMED else read_pattern(name_or_path)


def read_tokens(paths: Iterable[str]) -> list[str]:
    """JSON arrays of strings, one after another."""
    out: list[str] = []
    for p in paths:
        got = json.loads(Path(p).read_text(encoding="utf-8"))
        if not isinstance(got, list) or not all(isinstance(t, str) for t in got):
            raise ValueError(f"{p} isn't an array of strings")
        out += got
    return out


def write_tokens(tokens: Iterable[str], path: str) -> None:
    Path(path).write_text(json.dumps(list(tokens), ensure_ascii=False, indent=2), encoding="utf-8")


def vocab_frame(spark: SparkSession, tokens: Iterable[Token]) -> DataFrame:
    """A vocabulary as a table; ids are given, never implied by row order."""
    return spark.createDataFrame([(i, bytearray(t.value), float(t.score), t.keep) for i, t in enumerate(tokens)], VOCAB)


def vocab_list(vocab: DataFrame) -> list[Token]:
    """The table in order of id: of the vocabulary's size, whatever the corpus."""
    return [Token(bytes(r[1]), r[2], r[3]) for r in vocab.select("id", "value", "score", "keep").orderBy("id").collect()]
