"""Command line: generate, prune, filter, merge, regex, mine, encode, decode, evaluate.

    python -m lexloom.cli generate -v 32000 -o vocab.json --train code:data/*.bin:0.25 --processor crlf
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.functions.patterns import NAMED, java
from lexloom.functions.tokenizer import PROCESSORS, Tokenizer
from lexloom.operators import evaluate, mine, vocabulary
from lexloom.operators.encode import decode, encode, encoded_size, token_frequency
from lexloom.plans import train
from lexloom.sources import corpus

SPARK = Callable[[], SparkSession]


def _generate(a: argparse.Namespace, spark: SPARK) -> None:
    lists = {k: corpus.read_tokens(getattr(a, k)) for k in ("special", "suggested", "added")}
    samples = corpus.load(spark(), a.train, a.processor)
    allow = [corpus.pattern(a.allow)] if a.allow else None
    split = corpus.pattern(a.split) if a.split else None
    tok = train.generate(samples, a.vocab_size, processors=a.processor, special_tokens=lists["special"], added=lists["added"], suggested=lists["suggested"], allow=allow, split=split, p=a.insert_probability, max_bytes=a.max_token_length)
    tok.save(a.output)


def _prune(a: argparse.Namespace, spark: SPARK) -> None:
    tok = Tokenizer.from_file(a.input)
    samples = corpus.load(spark(), a.train, tok.processors)
    train.prune(samples, tok, a.vocab_size, dropout=a.dropout, shrink=a.shrink_factor, sub_iterations=a.em_subiters).save(a.output)


def _filter(a: argparse.Namespace, spark: SPARK) -> None:
    tok = Tokenizer.from_file(a.input)
    left = vocabulary.filtered(corpus.vocab_frame(spark(), tok.vocab), a.vocab_size, a.min_score, a.force)
    Tokenizer(corpus.vocab_list(left), tok.processors, tok.special_tokens()).save(a.output)


def _merge(a: argparse.Namespace, spark: SPARK) -> None:
    tok = Tokenizer.from_file(a.input)
    samples = corpus.load(spark(), a.train, tok.processors)
    train.merge(samples, tok, [corpus.pattern(a.allow)], merges=a.num_merges, step=a.step, scale=a.scale_factor, max_bytes=a.max_token_length).save(a.output)


def _regex(a: argparse.Namespace, spark: SPARK) -> None:
    if not a.output:
        for name in NAMED:
            print(f"{name}\t{java(name)}")
        return
    with open(a.output, "w", encoding="utf-8") as f:
        f.write("|".join(rf"\A(?:{java(p).removeprefix('(?d)')})\z" for p in a.pattern))


def _mine(a: argparse.Namespace, spark: SPARK) -> None:
    found = mine.mine(corpus.load(spark(), a.train), [corpus.pattern(p) if p in NAMED else p for p in a.pattern], a.num_idioms).collect()
    corpus.write_tokens([r["token"] for r in found], a.output)


def _encode(a: argparse.Namespace, spark: SPARK) -> None:
    s, tok = spark(), Tokenizer.from_file(a.vocab)
    rows = corpus.read_samples(s, a.input, "input")
    rows.select("sample_id", encode(s, tok, F.col("text")).alias("ids")).write.parquet(a.output)


def _decode(a: argparse.Namespace, spark: SPARK) -> None:
    s, tok = spark(), Tokenizer.from_file(a.vocab)
    corpus.write_samples(s.read.parquet(a.input).select(decode(s, tok, F.col("ids")).alias("text")), a.output)


def _evaluate(a: argparse.Namespace, spark: SPARK) -> None:
    s, tok = spark(), Tokenizer.from_file(a.vocab)
    samples = corpus.load(s, a.train)
    by = evaluate.compression(samples.withColumn("n_ids", encoded_size(s, tok, F.col("text"))))
    buckets = evaluate.frequency_buckets(token_frequency(samples, tok), tok.vocab_size()).orderBy("bucket")
    out = {"vocab_size": tok.vocab_size(), "compression": {r["source"]: {k: r[k] for k in ("num_tokens", "num_chars", "chars_per_token")} for r in by.collect()}, "frequency_buckets": [r["frequency"] for r in buckets.collect()]}
    with open(a.output, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=4)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *needs: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if "io" in needs:
            p.add_argument("-i", "--input", required=True)
        if "out" in needs:
            p.add_argument("-o", "--output", required=True)
        if "train" in needs:
            p.add_argument("--train", action="append", required=True, metavar="NAME:PATH[:PROPORTION]")
        return p

    p = command("generate", _generate, "out", "train")
    p.add_argument("-v", "--vocab-size", type=int, required=True)
    p.add_argument("--processor", action="append", default=[], choices=PROCESSORS)
    for k in ("special", "suggested", "added"):
        p.add_argument(f"--{k}", action="append", default=[], metavar="JSON")
    p.add_argument("--allow")
    p.add_argument("--split")
    p.add_argument("--insert-probability", type=float, default=0.1)
    p.add_argument("--max-token-length", type=int, default=24)
    p = command("prune", _prune, "io", "out", "train")
    p.add_argument("-v", "--vocab-size", type=int, required=True)
    p.add_argument("--dropout", type=float, default=0.01)
    p.add_argument("--shrink-factor", type=float, default=0.8)
    p.add_argument("--em-subiters", type=int, default=1)
    p = command("filter", _filter, "io", "out")
    p.add_argument("-v", "--vocab-size", type=int, default=0)
    p.add_argument("--min-score", type=float, default=float("-inf"))
    p.add_argument("--force", action="store_true")
    p = command("merge", _merge, "io", "out", "train")
    p.add_argument("--allow", required=True)
    p.add_argument("--num-merges", type=int, default=1000)
    p.add_argument("--step", type=int, default=50)
    p.add_argument("--scale-factor", type=float, default=0.9)
    p.add_argument("--max-token-length", type=int, default=24)
    p = command("regex", _regex)
    p.add_argument("-o", "--output")
    p.add_argument("-p", "--pattern", action="append", default=[])
    p = command("mine", _mine, "out", "train")
    p.add_argument("-n", "--num-idioms", type=int, required=True)
    p.add_argument("-p", "--pattern", action="append", required=True)
    for name, run in (("encode", _encode), ("decode", _decode)):
        command(name, run, "io", "out").add_argument("-v", "--vocab", required=True)
    command("evaluate", _evaluate, "out", "train").add_argument("-v", "--vocab", required=True)
    return top


def main(argv: list[str] | None = None, spark: SPARK = lambda: SparkSession.builder.getOrCreate()) -> None:
    a = parser().parse_args(argv)
    a.run(a, spark)


if __name__ == "__main__":
    main()
