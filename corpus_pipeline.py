"""The corpus pipeline: every stage works on all that its predecessor kept.

A stage takes the rows its predecessor returned, whole texts of all documents,
and returns rows with the columns of ``documents``; the last one returns where
every piece of every document lies in the training sequences.

Defined results, for every stage: null texts are judged as empty ones and stay
null where they are kept; texts of any length are worked on whole; rows with a
null or repeated ``doc_id`` are known by their text as well; extra columns,
whatever their names, are handed on; an empty table stays empty. The quality
stage keeps scores at the threshold and, without labels of both kinds, judges
all rows alike; of near-duplicates the row of the least ``doc_id`` stays, ties
going to the least digest; sanitised texts never come back to null; the mix
takes no empty text, and its ties are broken by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import documents, made, release, written
from docloom.llm.mixing import mixed_documents
from docloom.llm.packing import pack
from docloom.llm.privacy import sanitised
from docloom.llm.quality import accepted
from docloom.llm.simhash import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents the classifier rejects; a null text is scored as an
    empty one, a row without ``doc_id`` as any other."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as empty texts are of each
    other; of repeated rows one."""
    return deduplicated(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and terms that reveal it; ``n_chars``, where
    there is one, is that of the new text."""
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: rows as often as the mix has
    them, at most twice; a null source is one of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences; an
    empty or null text is its end id alone."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", privacy),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: Learned scores, fingerprints and tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            release(spark, before, keep=1)  # what led to this table
    return docs
