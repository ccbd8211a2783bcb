"""Corpus curation: quality filters, train and test quotas, infilling samples."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.sources.corpus import before_limits

LEAST_BYTES, MOST_BYTES = 16, 256 * 1024
DATA_LANGUAGES, DATA_LINES = ("json", "yaml", "toml", "sql", "r", "hcl"), 256
ENCODED = {
    "base64": r"[A-Za-z0-9+/=\n]{64,}",
    "hex": r"(?:\b(?:0x|\\x)?[A-Fa-f0-9]{2}(?:,|\b\s*)){8,}",
    "escapes": r"(?:\\u[A-Fa-f0-9]{4}){8,}",
}
GAP = "\x7f"


def measures(text: Column) -> dict[str, Column]:
    """What the filters look at, as columns."""
    n = F.greatest(F.length(text), F.lit(1))  # of an empty text only the size counts
    lines = F.split(text, "\n", -1)
    longest = F.array_max(F.transform(lines, F.length))
    share = lambda pattern: 1 - F.length(F.regexp_replace(text, pattern, "")) / n
    out = {
        "n_bytes": F.octet_length(text),
        "n_breaks": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))),
        "mean_line": (n - (F.size(lines) - 1)) / F.size(lines),
        "longest_line": longest,
        "alnum_share": share("[A-Za-z0-9]"),
        "digit_share": share(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"),  # what is a digit in any script
        "foreign_share": share("[^\\x00-\\x7f一-鿿㐀-䶿豈-﫿]"),
    }
    for name, p in ENCODED.items():
        sizes = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.length)
        out[f"{name}_longest"] = F.coalesce(F.array_max(sizes), F.lit(0))
        out[f"{name}_share"] = F.aggregate(sizes, F.lit(0), lambda a, b: a + b) / n
    return out


def reason(lang: Column) -> Column:
    """The first filter that a measured row fails, null if it passes all.

    The limit of 256 line breaks holds for data languages only; for others a
    large number of lines is no reason.
    """
    encoded = F.lit(False)
    for name in ENCODED:
        encoded = encoded | (F.col(f"{name}_longest") > 256) | (F.col(f"{name}_share") > 0.5)
    return (
        F.when((F.col("n_bytes") < LEAST_BYTES) | (F.col("n_bytes") > MOST_BYTES), "size")
        .when(lang.isin(*DATA_LANGUAGES) & (F.col("n_breaks") > DATA_LINES), "lines")
        .when((F.col("mean_line") > 100) | (F.col("mean_line") < 10) | (F.col("longest_line") > 1000), "line length")
        .when(F.col("alnum_share") < 0.25, "alphanumeric")
        .when(F.col("digit_share") > 0.3, "digits")
        .when(encoded, "encoded")
        .when(F.col("foreign_share") > 0.2, "script")
    )


def judged(docs: DataFrame) -> DataFrame:
    """The rows with their measures and ``reason``; a null or empty text fails on size."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.withColumns(measures(text))
    return measured.withColumn("reason", F.when(F.length(text) == 0, "size").otherwise(reason(F.col("lang"))))


def quality_filtered(docs: DataFrame) -> DataFrame:
    return judged(docs).where("reason is null").select(*docs.columns)


def quota_split(samples: DataFrame, test_bytes: int, train_bytes: int, order: str = "sample_id") -> DataFrame:
    """Each source's samples as test until it has ``test_bytes``, then as train; what comes after goes.

    A sample takes its bytes and one for its end.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    marked = before_limits(samples, order, size, {"__test": lambda _: F.lit(test_bytes), "__train": lambda _: F.lit(test_bytes + train_bytes)})
    return marked.where("__train").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test", "__train")


def infilling(samples: DataFrame, seed: int = 0, group: int = 4, picks: int = 10) -> DataFrame:
    """text: the samples in shuffled groups, of each sample ten of its chunks in random order, joined by U+007F.

    A chunk has a tenth of the sample's characters, 32 to 128; samples of fewer
    than ten chunks give none.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for t in rows["text"]:
                size = max(32, min(len(t) // 10, 128))
                parts = [t[i : i + size] for i in range(0, len(t), size)]
                rng = Random(f"{seed}:{t}")
                out.append(GAP.join(rng.sample(parts, picks)) if len(parts) >= picks else None)
            yield pd.DataFrame({"part": out, "at": [Random(f"{seed}/{t}").random() for t in rows["text"]]})

    parts = samples.select("text").where("text is not null").mapInPandas(cut, "part string, at double").where("part is not null")
    # groups form within hash ranges of about a thousand, so nothing is ranked globally
    spread = parts.withColumn("g", F.floor(F.col("at") * max(1, -(-samples.count() // 1000))))
    ranked = spread.withColumn("k", F.floor((F.row_number().over(Window.partitionBy("g").orderBy("at", "part")) - 1) / group))
    made = ranked.groupBy("g", "k").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    return made.select(F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))
