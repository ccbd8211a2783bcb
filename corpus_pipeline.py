"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; it is written
as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontam, packing, quality, simhash, suffix_dedup
from lexloom.llm._spark import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves go.

    Null, empty and wordless texts stay; ids don't matter; repeated rows are
    judged alike; columns pass through; an empty table stays empty.
    """
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Rows without id, text or words stay; rows that share an id but not a text
    are documents of their own; rows equal in both share their fate; of equal
    ids the smaller hash of the text stays; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; a document that is left without words goes.

    Rows without id, and null, empty and short texts, stay as they are; the
    order is that of doc_id, then of the text's hash; rows equal in both are one
    document; n_chars follows the text; an empty table stays empty.
    """
    return suffix_dedup.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut, and documents that mostly consist of them go.

    Rows without id are treated like others; null, empty and wordless texts stay;
    items without id or of under four words match nothing; n_chars follows the
    text; an empty table, or benchmark, changes nothing.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in windows: (pack_id, slot, doc_id, start_token, n_tokens).

    Null and empty texts take no place; rows with null or repeated ids are packed
    each for itself; other columns are left out; an empty table gives an empty one.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]
#: No stage can be put in SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
