"""Reports: compression, frequency buckets, occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.columns import occurrences

BUCKETS = 50


def compression(encoded: DataFrame) -> DataFrame:
    """num_tokens, num_chars, chars_per_token of every source, from source, text and ids, or n_ids, their number."""
    n = F.col("n_ids") if "n_ids" in encoded.columns else F.size("ids")
    sums = encoded.groupBy("source").agg(F.sum(n).alias("num_tokens"), F.sum(F.char_length("text")).alias("num_chars"))
    return sums.withColumn("chars_per_token", F.round(F.col("num_chars") / F.col("num_tokens"), 2))


def compression_report(by_source: DataFrame, subsets: dict[str, list[str]]) -> DataFrame:
    """The sources by size, then the average of all, and of each subset whose sources are all there."""
    ratio = F.round(F.sum("num_chars") / F.sum("num_tokens"), 2).alias("chars_per_token")
    cols = [F.sum("num_tokens").alias("num_tokens"), F.sum("num_chars").alias("num_chars"), ratio]
    out = by_source.select(F.lit("source").alias("kind"), F.col("source").alias("name"), "num_tokens", "num_chars", "chars_per_token")
    out = out.unionAll(by_source.agg(*cols).select(F.lit("average"), F.lit("all"), "num_tokens", "num_chars", "chars_per_token"))
    for name, of in subsets.items():
        part = by_source.where(F.col("source").isin(of)).agg(F.count("*").alias("n"), *cols).where(F.col("n") == len(set(of)))
        out = out.unionAll(part.select(F.lit("average"), F.lit(name), "num_tokens", "num_chars", "chars_per_token"))
    return out.orderBy(F.desc("kind"), F.desc("num_chars"), "name")


def frequency_buckets(freq: DataFrame, vocab_size: int, buckets: int = BUCKETS) -> DataFrame:
    """bucket, frequency: tokens by falling frequency in equal buckets; ids left over at the end count in none."""
    each = vocab_size // buckets
    slots = freq.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), "id")) - 1
    top = freq.select("id", "freq").orderBy(F.desc("freq"), "id").limit(buckets * each)  # what is ranked is no more than the vocabulary
    place = top.select(F.floor(rank / max(each, 1)).cast("int").alias("bucket"), "freq").where(F.lit(each > 0))
    sums = place.groupBy("bucket").agg(F.sum("freq").alias("frequency"))
    return slots.join(sums, "bucket", "left").select("bucket", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def bucket_shares(buckets: DataFrame) -> DataFrame:
    """bucket, frequency and its percentage of all buckets' sum."""
    whole = F.sum("frequency").over(Window.partitionBy())
    return buckets.select("bucket", "frequency", F.when(whole > 0, F.round(100.0 * F.col("frequency") / whole, 2)).alias("percent"))


def find(samples: DataFrame, needle: str) -> DataFrame:
    """occurrences, samples_hit and percent of samples of every source that has any, and in total (source null)."""
    if not needle:
        raise ValueError("there must be something to find")
    k = occurrences(F.col("text"), F.lit(needle))
    each = samples.select("source", k.alias("k")).rollup("source").agg(F.sum("k").alias("occurrences"), F.count_if(F.col("k") > 0).alias("samples_hit"), F.count("*").alias("samples"), F.grouping("source").alias("is_total"))
    kept = each.where((F.col("occurrences") > 0) | (F.col("is_total") == 1))
    return kept.select("source", "is_total", "occurrences", "samples_hit", F.round(100.0 * F.col("samples_hit") / F.col("samples"), 2).alias("percent"))
