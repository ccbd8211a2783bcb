"""The training loops: generate, prune, merge.

A loop's state is the vocabulary, which comes to the driver each round (its
size is bounded by the parameters); the corpus never does, and no plan grows
with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.patterns import allow_regex
from lexloom.functions.tokenizer import Token, Tokenizer
from lexloom.operators import generate as g
from lexloom.operators import prune as p
from lexloom.operators.encode import sample_pair_counts, token_frequency
from lexloom.sources.corpus import vocab_frame, vocab_list


def generate(samples: DataFrame, size: int, *, processors: list[str] = [], special_tokens: list[str] = [], added: list[str] = [], suggested: list[str] = [], **kw) -> Tokenizer:  # noqa: B006
    """A tokenizer from substring frequencies; ``samples`` are processed already."""
    freq = g.document_frequency(samples, added=added, suggested=suggested, **kw)
    return Tokenizer(vocab_list(g.seed_vocabulary(freq, size, added, suggested)), processors, special_tokens)


def prune(samples: DataFrame, tokenizer: Tokenizer, size: int, *, dropout: float = 0.01, shrink: float = 0.8, sub_iterations: int = 1, seed: int = 0) -> Tokenizer:
    """Rounds of expectation, maximisation and pruning until at most ``size`` tokens are left, or a round changes nothing."""
    spark = samples.sparkSession
    n = samples.count()
    vocab = list(tokenizer.vocab)
    turn = 0
    while len(vocab) > size:
        before = [(t.value, t.score) for t in vocab]
        for _ in range(sub_iterations):
            turn += 1
            expected = p.expected_counts(samples, Tokenizer(vocab), dropout, seed + turn)
            vocab = vocab_list(p.reestimated(vocab_frame(spark, vocab), expected))
        now = Tokenizer(vocab)
        frame = vocab_frame(spark, vocab)
        counts = token_frequency(samples, now).collect()  # at most one row a token
        freq = spark.createDataFrame(counts, "id int, freq long")
        judged = p.losses(frame, p.alternatives(frame, now), freq, n)
        vocab = vocab_list(p.pruned(judged, max(int(len(vocab) * shrink), size)))
        if len(vocab) >= len(before):
            break
    return Tokenizer(vocab, tokenizer.processors, tokenizer.special_tokens())


def best_pairs(samples: DataFrame, tokenizer: Tokenizer, n: int, allow: list[str], max_bytes: int, scale: float) -> DataFrame:
    """a, b, freq, value, score: the ``n`` most frequent pairs whose join is allowed and new."""
    spark = samples.sparkSession
    vocab = vocab_frame(spark, tokenizer.vocab)
    side = lambda c: vocab.select(F.col("id").alias(c), F.col("value").alias(f"{c}_value"), F.col("score").alias(f"{c}_score"))
    joined = sample_pair_counts(samples, tokenizer).join(side("a"), "a").join(side("b"), "b")
    joined = joined.select("a", "b", "freq", F.concat("a_value", "b_value").alias("value"), ((F.col("a_score") + F.col("b_score")) * scale).alias("score"))
    valid = joined.where((F.octet_length("value") <= max_bytes) & F.expr("make_valid_utf8(value)").rlike(allow_regex(allow)))
    return valid.orderBy(F.desc("freq"), "a", "b").limit(n)


def merge(samples: DataFrame, tokenizer: Tokenizer, allow: list[str], *, merges: int = 1000, step: int = 50, scale: float = 0.9, max_bytes: int = 24) -> Tokenizer:
    """Appends joins of frequent pairs, ``step`` in a round, until there are ``merges`` or a round finds none."""
    out = Tokenizer(tokenizer.vocab, tokenizer.processors, tokenizer.special_tokens())
    done = 0
    while done < merges:
        rows = best_pairs(samples, out, min(step, merges - done), allow, max_bytes, scale).collect()  # at most ``step``
        if not rows:
            break
        out.add_base_tokens([Token(bytes(r["value"]), r["score"]) for r in rows])
        done += len(rows)
    return out
