"""Helpers shared by the training-data operators: the shared work folder,
written intermediate tables, size-checked broadcasts and distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import fresh_folder
from ..sources.spread import spread

#: A side is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Python stages work on at most this many bytes of text at a time.
CHUNK_BYTES = 2 << 20
#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    path = fresh_folder(spark, name)
    _made.append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage with a copy that outlives any executor, and lets several
    later passes read only the columns they need."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[str] = []


def made() -> int:
    """How many intermediate tables this process has written and not deleted."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the intermediate tables this process has written, but for the
    first ``since`` and the last ``keep``; to be called when the results that
    build on them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end = len(_made) - keep
    gone = _made[since:end]
    del _made[since:end]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a 128-bit digest of the text, k1 and k2."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *digests())


def digests(names: Sequence[str] = ("k1", "k2")) -> list[Column]:
    """A 128-bit digest of the text (null: that of the empty text)."""
    return [F.xxhash64(text_bytes()).alias(names[0]), F.xxhash64(text_bytes(), F.lit("second")).alias(names[1])]


def text_bytes(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text (one document
    at least): slice, its text's bytes end to end, and the offsets of them."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_binary(col.type):
            col = col.cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        n = len(col)
        if not n:
            continue
        bufs = col.buffers()
        off = np.frombuffer(bufs[1], np.int64, n + 1 + col.offset)[col.offset :]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def texts(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As :func:`chunks`, with the texts as a list of bytes."""
    for part, data, off in chunks(batches, text, limit):
        raw, o = data.tobytes(), off.tolist()
        yield part, [raw[x:y] for x, y in zip(o, o[1:])]


class appended:
    """A table in the shared folder that grows by whole DataFrames."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = folder(spark, name)
        self._any = False

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(self.path)
        self._any = True

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self._any else self.spark.createDataFrame([], self.schema)


def column_bytes(c: Column, kind: T.DataType) -> Column:
    """About how much memory a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType)):
            each = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        else:
            each = F.size(c) * 8
        return F.coalesce(each, F.lit(0)) + 24
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """The measured size of ``df``, from the lengths of all its values; for
    tables that are written already, so that measuring is cheap."""
    per_row = reduce(lambda a, b: a + b, [column_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    return df.agg(F.coalesce(F.sum((per_row + 16).cast("long")), F.lit(0))).first()[0]


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts ``right`` only if its measured size is small, else shuffles
    both (AQE splits skewed keys)."""
    return left.join(F.broadcast(right) if table_bytes(right) <= limit else right, on, how)


def rank_within(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int = 0, total: str | None = None, per_key: DataFrame | None = None, bits: int = 12, salt: str | None = None) -> DataFrame:
    """``df`` with ``rank``: gapless from 0 within each of ``keys``, in a
    seeded random order; with ``total``, ``before``: that column's sum over
    smaller ranks. ``keys`` must not be null; ``df`` must be written already,
    as it is read twice. ``per_key``: columns by key to add on the way.

    No key's rows meet in one task: they are counted in 2**bits hashed blocks,
    the blocks are summed up, and only a block is ever sorted. Rows whose first
    id is null come last; any number of them may be alike, so they are spread
    by ``salt``, a number written with the row."""
    keys, ids = list(keys), list(ids)
    h, b = F.xxhash64(*ids, F.lit(seed)), F.shiftrightunsigned("_h", 64 - bits)
    if salt:
        nameless = F.col(ids[0]).isNull()
        h = F.when(nameless, F.xxhash64(salt, F.lit(seed))).otherwise(h)
        b = b + F.when(nameless, 1 << bits).otherwise(0)
    d = df.withColumn("_h", h).withColumn("_b", b.cast("int"))
    by = [*keys, "_b"]
    aggs = [F.count("*").alias("_n")] + ([F.sum(total).alias("_t")] if total else [])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by).agg(*aggs).withColumn("_r0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        base = base.withColumn("_t0", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    if per_key is not None:
        base = base.join(per_key, keys)
    inside = Window.partitionBy(*by).orderBy("_h", *ids)
    out = d.join(base.drop("_n", "_t"), by).withColumn("rank", F.row_number().over(inside) - 1 + F.col("_r0"))
    if total:
        out = out.withColumn("before", F.coalesce(F.sum(total).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_t0"))
    return out.drop("_h", "_b", "_r0", "_t0")
