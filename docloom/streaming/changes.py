"""Predicates and differences on streams (beyond the document model's scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.collection import find
from ..plans import predicates as P
from ..sources.store import Store


def find_stream(stream: DataFrame, p: P.Predicate) -> DataFrame:
    """The same compiled filter as on a table."""
    return find(stream, p)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window, dropping what is later than ``late``."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Every micro-batch becomes a version of ``store``. The batch's number is
    part of that commit, so a batch replayed after a failure is skipped, and one
    that wasn't committed is applied once."""

    def put(batch: DataFrame, number: int) -> None:
        done = store.meta().get("batch", -1)
        if number <= done or batch.isEmpty():
            return
        store.upsert(batch, meta={"batch": number})

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
