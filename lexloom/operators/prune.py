"""The steps of pruning: expected counts, re-estimation, alternatives, loss."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.columns import digamma
from lexloom.functions.tokenizer import Tokenizer
from lexloom.operators.encode import Shared, chunk_counts, weighted_by_chunk

SNIPPET = 81_920
THRESHOLD = 0.5


def expected_counts(samples: DataFrame, tokenizer: Tokenizer, dropout: float = 0.0, seed: int = 0, snippet: int = SNIPPET) -> DataFrame:
    """id, expected: the expected number of each token over all segmentations, weighted by likelihood.

    Without dropout each distinct chunk is worked out once and weighted by its
    number; with it every occurrence has a lattice of its own.
    """
    shared = Shared(samples.sparkSession, tokenizer)
    if dropout <= 0:
        found = weighted_by_chunk(chunk_counts(samples, shared, snippet), shared, lambda lattice, c: lattice.expected(c)[0], "double")
        return found.select("id", F.col("amount").alias("expected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = shared.get().lattice, {}
        for rows in batches:
            for t in rows.column(0).to_pylist():
                raw, rng = t.encode(errors="surrogatepass"), Random(f"{seed}:{t}")
                for a in range(0, len(raw), snippet):
                    for c in lattice.chunks(raw[a : a + snippet]):
                        for k, x in lattice.expected(c, lattice.edges(c, dropout, rng))[0].items():
                            total[k] = total.get(k, 0.0) + x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["id", "expected"])

    texts = samples.select("text").where("text is not null and text <> ''")
    return texts.mapInArrow(run, "id int, expected double").groupBy("id").agg(F.sum("expected").alias("expected"))


def reestimated(vocab: DataFrame, expected: DataFrame) -> DataFrame:
    """The vocabulary with new scores, in the order of ids: rare tokens go unless kept, counts are at least the threshold."""
    joined = vocab.drop("score").join(expected, "id", "left").withColumn("f", F.coalesce("expected", F.lit(0.0)))
    stay = joined.where((F.col("f") >= THRESHOLD) | F.col("keep")).withColumn("f", F.greatest("f", F.lit(THRESHOLD)))
    total = F.sum("f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("id")) - 1
    return stay.select(rank.cast("int").alias("id"), "value", (digamma(F.col("f")) - digamma(total)).alias("score"), "keep")


def alternatives(vocab: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """id, always_keep, alt_ids: what each token falls into if it is taken away."""
    shared = Shared(vocab.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.get().lattice
        for rows in batches:
            ids = rows.column(0)
            keep, alts = zip(*map(lattice.alternative, ids.to_pylist())) if len(ids) else ((), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(keep, pa.bool_()), pa.array(alts, pa.list_(pa.int32()))], ["id", "always_keep", "alt_ids"])

    n = max(1, int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return vocab.select("id").repartition(n, "id").mapInArrow(run, "id int, always_keep boolean, alt_ids array<int>")


def losses(vocab: DataFrame, alts: DataFrame, freq: DataFrame, n_samples: int) -> DataFrame:
    """id, value, score, keep, rule (stay, drop or candidate) and the candidates' loss.

    The loss takes every occurrence of the token to fall into its
    alternatives.  The growth of the total is counted with the size of the
    whole vocabulary, not the path's: that is the defined result.
    """
    base = vocab.join(freq, "id", "left").withColumn("f", F.coalesce("freq", F.lit(0))).drop("freq").join(alts, "id")
    total = freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("double").alias("s"))
    size = vocab.agg(F.count("*").alias("v"))
    base = base.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size))
    rule = (
        F.when(F.col("keep"), "stay")
        .when((F.col("f") == 0) & ~F.col("always_keep"), "drop")
        .when(F.size("alt_ids") == 0, "stay")
        .when(F.col("f") > 0, "candidate")
        .otherwise("drop")
    )
    base = base.withColumn("rule", rule)
    each = base.where("rule = 'candidate'").select("id", "f", "s", "v", F.explode("alt_ids").alias("alt_id"))
    each = each.join(freq.select(F.col("id").alias("alt_id"), F.col("freq").alias("g")), "alt_id", "left")
    grown = F.log(F.col("s") + F.col("f") * (F.col("v") - 1))
    alt = each.groupBy("id").agg(F.sum(F.log((F.coalesce("g", F.lit(0)) + F.col("f")).cast("double")) - grown).alias("alt"))
    loss = F.col("f") / F.lit(float(max(n_samples, 1))) * (F.log(F.col("f").cast("double")) - F.log("s") - F.col("alt"))
    return base.join(alt, "id", "left").select("id", "value", "score", "keep", "rule", F.when(F.col("rule") == "candidate", loss).alias("loss"))


def pruned(judged: DataFrame, size: int) -> DataFrame:
    """Those that stay, and the candidates of highest loss as far as ``size`` goes; ids by score.

    If more than ``size`` stay anyway, no candidate is taken, so that pruning always makes progress.
    """
    free = F.lit(size) - F.sum((F.col("rule") == "stay").cast("long")).over(Window.partitionBy())
    ranked = judged.withColumns({"__k": F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("loss"), "value")), "__free": free})
    left = ranked.where((F.col("rule") == "stay") | ((F.col("rule") == "candidate") & (F.col("__k") <= F.col("__free"))))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "value")) - 1
    return left.select(rank.cast("int").alias("id"), "value", "score", "keep")
