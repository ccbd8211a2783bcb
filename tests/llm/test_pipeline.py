"""The stages one after another, and the registration of the queries."""

import random

import corpus_pipeline
from lexloom.llm import queries

import __spark_entry__ as entry


def rand(rng, n):
    return " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(0)
    passage, item = rand(rng, 60), rand(rng, 14)
    clean = [rand(rng, rng.randrange(80, 200)) for _ in range(12)]
    near = clean[0].split()
    near[40] = "changed"
    texts = [*clean, clean[1], " ".join(near), "again and again it says the same old thing " * 60, f"{rand(rng, 90)} {passage}", f"{passage} {rand(rng, 90)}", f"{rand(rng, 100)} {item}", item, None, ""]
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {r["doc_id"] for r in docs.collect()}
    assert set(range(21)) - set(seen["quality_rules"]) == {14}
    assert set(seen["quality_rules"]) - set(seen["simhash_near_dedup"]) == {12, 13}
    dedup = seen["suffix_array_dedup"]
    assert dedup[15].endswith(passage) and dedup[16] == texts[16].removeprefix(passage).strip()
    left = seen["benchmark_decontamination"]
    assert 18 not in left and item not in left[17] and all(left[i] == clean[i] for i in range(12))
    assert seen["packing"] == {*range(12), 15, 16, 17}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} == seen["packing"]


def test_registration():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())
