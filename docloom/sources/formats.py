"""Other sources and sinks: JSON documents, schemaless variants, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder of JSON documents, one per line or file."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("compression", compression).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (id, doc): the file's name and a VARIANT."""
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.col("_metadata.file_name"))
    return files.select(F.regexp_replace("_f", r"\.json$", "").alias("id"), F.try_parse_json("value").alias("doc"))


def parse_documents(df: DataFrame, column: str, into: str = "doc") -> DataFrame:
    return df.withColumn(into, F.try_parse_json(column))


def encrypted(c: Column, key: Column, aad: Column | None = None) -> Column:
    """AES-GCM with a random 12-byte IV in front."""
    args = (c, key, F.lit("GCM"), F.lit("DEFAULT"))
    return F.aes_encrypt(*args) if aad is None else F.aes_encrypt(*args, F.lit(b""), aad)


def decrypted(c: Column, key: Column, aad: Column | None = None) -> Column:
    """Null instead of an error for what doesn't authenticate."""
    args = (c, key, F.lit("GCM"), F.lit("DEFAULT"))
    return F.try_aes_decrypt(*args) if aad is None else F.try_aes_decrypt(*args, aad)
