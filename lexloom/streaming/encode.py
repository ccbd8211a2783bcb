"""Encoding a stream: the same columns over readStream, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.tokenizer import Tokenizer
from lexloom.operators.encode import encode


def encoded_stream(spark: SparkSession, path: str, schema: str, tokenizer: Tokenizer, files: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """The rows of a growing folder of Parquet files, with ids; where ``files`` names a folder in it, of that one's files."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(path, files)
    disk = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    if disk.exists(whole) and disk.getFileStatus(whole).isDirectory():
        path, files = f"{path}/{files}", "*"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(path)
    return rows.withColumn("ids", encode(spark, tokenizer, F.col("text")))


def encode_available(spark: SparkSession, path: str, schema: str, tokenizer: Tokenizer, out: str, checkpoint: str, files: str = "*") -> DataFrame:
    """Encodes what has arrived since the last call into ``out``, exactly once, and returns all of it."""
    stream = encoded_stream(spark, path, schema, tokenizer, files)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
