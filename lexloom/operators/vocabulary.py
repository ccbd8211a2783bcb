"""Relational steps on a vocabulary table (id, value, score, keep)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def renumbered(vocab: DataFrame) -> DataFrame:
    """Ids by descending score, ties by bytes."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "value")) - 1
    return vocab.select(rank.cast("int").alias("id"), "value", "score", "keep")


def filtered(vocab: DataFrame, size: int = 0, min_score: float = float("-inf"), force: bool = False) -> DataFrame:
    """Removes tokens of lowest score that have at most ``min_score``, as long as there are more than ``size``.

    Tokens marked keep stay unless ``force``.
    """
    free = (F.col("score") <= min_score) & (F.lit(force) | ~F.col("keep"))
    order = Window.orderBy(F.when(free, 0).otherwise(1), "score", F.desc("value"))
    excess = F.count("*").over(Window.partitionBy()) - size
    marked = vocab.withColumns({"__free": free, "__k": F.row_number().over(order), "__excess": excess})
    return renumbered(marked.where(~F.col("__free") | (F.col("__k") > F.col("__excess"))))


def token_ids(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with the id of each, null where there is none; of equal values the last id has the say."""
    last = vocab.groupBy("value").agg(F.max("id").alias("id"))
    return tokens.join(F.broadcast(last), tokens[token].cast("binary") == last["value"], "left").drop("value")


def id_tokens(ids: DataFrame, vocab: DataFrame, specials: DataFrame | None = None) -> DataFrame:
    """``ids`` (a column id) with value and is_special; ids beyond the base vocabulary are special tokens."""
    named = vocab.select("id", "value", F.lit(False).alias("is_special"))
    if specials is not None:
        base = vocab.agg(F.count("*").alias("base"))
        named = named.unionAll(specials.crossJoin(F.broadcast(base)).select((F.col("base") + F.col("ordinal")).cast("int"), F.col("token").cast("binary"), F.lit(True)))
    return ids.join(F.broadcast(named), "id", "left")


def sizes(vocab: DataFrame, specials: DataFrame) -> DataFrame:
    """vocab_size, base_vocab_size, special_vocab_size."""
    a, b = vocab.agg(F.count("*").alias("base_vocab_size")), specials.agg(F.count("*").alias("special_vocab_size"))
    return a.crossJoin(b).withColumn("vocab_size", F.col("base_vocab_size") + F.col("special_vocab_size"))


def prefix_search(texts: DataFrame, vocab: DataFrame, text: str = "text", longest: int | None = None) -> DataFrame:
    """(text, id, n_bytes) of every token that is a prefix of a distinct text: an equi-join on its prefixes, not a scan of pairs."""
    if longest is None:
        longest = vocab.agg(F.max(F.octet_length("value"))).first()[0] or 0
    raw = texts.select(F.col(text).alias("text")).where("text <> ''").distinct().withColumn("raw", F.col("text").cast("binary"))
    ends = F.sequence(F.lit(1), F.least(F.octet_length("raw"), F.lit(max(longest, 1))))
    cut = raw.select("text", "raw", F.explode(ends).alias("n_bytes")).withColumn("value", F.substring("raw", F.lit(1), F.col("n_bytes")))
    return cut.join(F.broadcast(vocab.groupBy("value").agg(F.max("id").alias("id"))), "value").select("text", "id", "n_bytes")
