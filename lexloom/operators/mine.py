"""Idioms: how often each match of a pattern occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.patterns import mine_regex


def idiom_counts(samples: DataFrame, patterns: list[str]) -> DataFrame:
    """token, freq of all matches (every occurrence counts) of any of ``patterns``."""
    found = F.regexp_extract_all("text", F.lit(mine_regex(patterns)), F.lit(0))
    return samples.select(F.explode(found).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("freq"))


def mine(samples: DataFrame, patterns: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent idioms; of equal ones the smaller token comes first."""
    return idiom_counts(samples, patterns).orderBy(F.desc("freq"), "token").limit(n)
