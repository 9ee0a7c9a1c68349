"""A versioned document store on Parquet.

Rows are hashed by id into buckets, whose number grows with the table: a write
to a store with more than ``BUCKET_ROWS`` rows a bucket spreads it over more. A
large bucket is several files, written by as many tasks. A write makes new files
for the buckets it touches only, and then a manifest that names the files of
every bucket; creating the manifest of the next number is the commit, and fails
if somebody else made it first. Versions are immutable, so readers and
transactions pin one by its number. What a failed write leaves behind is never
named by a manifest, and is swept by :meth:`Store.vacuum`."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentExists, DocumentNotFound, StorageError, VersionConflict
from ..operators.changes import assigned, merged, without
from .files import Files

VERSION = "__version"
ID = "id"
#: Rows to a bucket before there are more buckets, and to a file of one.
BUCKET_ROWS = 1 << 22
FILE_ROWS = 1 << 19
SEALED = "_sealed"
STAMP, STAMP_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None, buckets: int = 8, compression: str = "zstd", bucket_rows: int = BUCKET_ROWS, key: bytes | None = None):
        """``key`` (16, 24 or 32 bytes): a new store is encrypted with it."""
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.compression, self.bucket_rows, self.key = compression, bucket_rows, key
        newest = self.latest()
        if newest is None:
            if schema is None:
                raise StorageError(f"no store in {root}")
            full = T.StructType([f for f in schema if f.name != VERSION]).add(VERSION, T.LongType())
            self._commit(0, {"schema": full.json(), "buckets": buckets, "files": {}, "counts": {}, "rows": 0, "meta": {}, "sealed": key is not None})

    # manifests

    def _name(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and n[:12].isdigit()]

    def latest(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(self._name(self.latest() if version is None else version)))

    def _commit(self, version: int, manifest: dict) -> int:
        if not self.files.create(self._name(version), json.dumps(manifest | {"version": version, "time": time.time()})):
            raise VersionConflict(f"version {version} of {self.root} exists")
        return version

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._open(m, sorted(set(m["files"].values())))

    def count(self, version: int | None = None) -> int:
        """From the manifest; no scan."""
        return self.manifest(version)["rows"]

    def meta(self) -> dict:
        return self.manifest()["meta"]

    def get(self, id_: str) -> DataFrame:
        """The files of one bucket at most are opened, and pruned by id."""
        m = self.manifest()
        b = self.spark.sql("select pmod(xxhash64(:i), :n) as b", {"i": id_, "n": m["buckets"]}).first()[0]
        return self._open(m, [m["files"][str(b)]] if str(b) in m["files"] else []).filter(F.col(ID) == id_)

    def _open(self, m: dict, parts: Sequence[str]) -> DataFrame:
        """Some of a version's files. Rows of an encrypted store are opened as
        they are read; one that was tampered with is an error."""
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        paths = [f"{self.root}/data/{p}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if not m.get("sealed"):
            return self.spark.read.schema(schema).parquet(*paths)
        if self.key is None:
            raise StorageError(f"{self.root} is encrypted")
        kept = T.StructType([schema[ID], T.StructField(SEALED, T.BinaryType()), schema[VERSION]])
        names = T.StructType([f for f in schema if f.name not in (ID, VERSION)])
        opened = F.aes_decrypt(F.col(SEALED), F.lit(self.key), F.lit("GCM"), F.lit("DEFAULT"), F.col(ID).cast("string").cast("binary")).cast("string")
        df = self.spark.read.schema(kept).parquet(*paths).withColumn(SEALED, F.from_json(opened, names, {"timestampFormat": STAMP, "timestampNTZFormat": STAMP_NTZ}))
        return df.select(*(F.col(f.name) if f.name in (ID, VERSION) else F.col(SEALED)[f.name].alias(f.name) for f in schema))

    def _sealed(self, df: DataFrame) -> DataFrame:
        """(id, the other columns as AES-GCM of their JSON, bound to the id,
        version)."""
        names = [c for c in df.columns if c not in (ID, VERSION)]
        text = F.to_json(F.struct(*names), {"timestampFormat": STAMP, "timestampNTZFormat": STAMP_NTZ}).cast("binary")
        sealed = F.aes_encrypt(text, F.lit(self.key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col(ID).cast("string").cast("binary"))
        return df.select(ID, sealed.alias(SEALED), VERSION)

    # writing

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(ID), F.lit(n)).cast("int")

    def _buckets_for(self, rows: int, now: int) -> int:
        """Twice as many until they hold that many rows."""
        while rows > now * self.bucket_rows:
            now *= 2
        return now

    def _write(self, base: int, rows: DataFrame, touched: Sequence[int] | None, meta: dict | None = None, schema: T.StructType | None = None, expect: int = 0) -> int:
        """Commits ``rows`` as the new contents of the buckets ``touched``, or
        of all. ``expect``: about how many there are, if that is known."""
        m = self.manifest(base)
        if touched is None:
            m["buckets"] = self._buckets_for(expect, m["buckets"])
        n = m["buckets"]
        touched = range(n) if touched is None else touched
        part = uuid.uuid4().hex
        schema = schema or T.StructType.fromJson(json.loads(m["schema"]))
        out = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        out = (self._sealed(out) if m.get("sealed") else out).withColumn("_bucket", self._bucket(n))
        target = f"{self.root}/data/{part}"
        files = max(1, -(-expect // (max(1, len(touched)) * FILE_ROWS)))
        out = out.repartition(F.col("_bucket"), F.pmod(F.xxhash64(ID, F.lit("file")), F.lit(files))).sortWithinPartitions("_bucket", ID)
        out.write.option("compression", self.compression).partitionBy("_bucket").parquet(target)
        new = self.spark.read.schema(out.schema).parquet(target).groupBy("_bucket").count().collect()  # one row per bucket
        replaced = set(touched)
        files = {b: p for b, p in m["files"].items() if int(b) not in replaced}
        counts = {b: c for b, c in m["counts"].items() if int(b) not in replaced}
        files |= {str(b): f"{part}/_bucket={b}" for b, _ in new}
        counts |= {str(b): c for b, c in new}
        fresh = m | {"files": files, "counts": counts, "rows": sum(counts.values()), "schema": schema.json(), "meta": m["meta"] | (meta or {})}
        return self._commit(base + 1, fresh)

    def _touched(self, ids: DataFrame, n: int) -> list[int]:
        return [r[0] for r in ids.select(self._bucket(n).alias("b")).distinct().collect()]  # one row per bucket

    def _in(self, base: int, buckets: Sequence[int]) -> DataFrame:
        m = self.manifest(base)
        return self._open(m, [m["files"][str(b)] for b in buckets if str(b) in m["files"]])

    def _held(self, base: int, buckets: Sequence[int] | None) -> int:
        """Rows of some buckets, or all, by the manifest."""
        m = self.manifest(base)
        return m["rows"] if buckets is None else sum(m["counts"].get(str(b), 0) for b in buckets)

    @contextmanager
    def with_ids(self, rows: DataFrame) -> Iterator[DataFrame]:
        """New ids where there are none. They are random, so the rows are
        written before anything is decided on them, and deleted afterwards."""
        if ID not in rows.columns:
            rows = rows.withColumn(ID, F.lit(None).cast("string"))
        path = f"{self.root}/incoming/{uuid.uuid4().hex}"
        rows = rows.withColumn(ID, F.coalesce(F.col(ID), F.expr("uuid()"))).withColumn("_at", F.monotonically_increasing_id())
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.files.delete(path)

    def _merge(self, rows: DataFrame, base: int | None, check: str | None, meta: dict | None = None) -> int:
        with self.with_ids(rows) as fresh:
            return self._merged(fresh, self.latest() if base is None else base, check, meta)

    def _merged(self, rows: DataFrame, base: int, check: str | None, meta: dict | None) -> int:
        m = self.manifest(base)
        n, new = m["buckets"], rows.count()
        grown = self._buckets_for(m["rows"] + new, n) != n
        touched = None if grown else self._touched(rows, n)
        old = self.read(base) if grown else self._in(base, touched)
        expect = new + self._held(base, touched)
        if check == "insert":
            clash = rows.join(old, ID, "left_semi").select(ID).limit(5).collect()
            if clash:
                raise DocumentExists(", ".join(r[0] for r in clash))
        if check == "update":
            lost = rows.join(old, ID, "left_anti").select(ID).limit(5).collect()
            if lost:
                raise DocumentNotFound(", ".join(r[0] for r in lost))
            if VERSION in rows.columns:
                stale = rows.alias("r").join(old.alias("o"), ID).filter(f"r.{VERSION} is not null and r.{VERSION} <> o.{VERSION}").select(ID).limit(5).collect()
                if stale:
                    raise VersionConflict(", ".join(r[0] for r in stale))
        names = [c for c in old.columns if c not in (ID, VERSION)]
        # rows of one batch with the same id collapse, the last one wins
        fresh = rows.groupBy(ID).agg(F.max_by(F.struct(*names), "_at").alias("_new"))
        kept = merged(old, fresh.select(ID, *(F.col("_new")[c].alias(c) for c in names)), ID, VERSION)
        return self._write(base, kept, touched, meta, expect=expect)

    def insert(self, rows: DataFrame, base: int | None = None) -> int:
        return self._merge(rows, base, "insert")

    def update(self, rows: DataFrame, base: int | None = None) -> int:
        """Rows with a ``__version`` must have the stored one."""
        return self._merge(rows, base, "update")

    def upsert(self, rows: DataFrame, base: int | None = None, meta: dict | None = None) -> int:
        """``meta`` becomes part of the same commit."""
        return self._merge(rows, base, None, meta)

    def update_where(self, condition, assignments: dict, base: int | None = None) -> int:
        """Sets columns to expressions of the row where ``condition`` holds."""
        base = self.latest() if base is None else base
        df = self.read(base)
        hit = F.coalesce(condition, F.lit(False))
        touched = self._touched(df.filter(hit), self.manifest(base)["buckets"])
        df, expect = self._in(base, touched), self._held(base, touched)
        new = assigned(df, condition, assignments, VERSION)
        return self._write(base, new, touched, expect=expect)

    def delete(self, ids: DataFrame, base: int | None = None) -> tuple[int, int]:
        """(version, rows deleted)."""
        base = self.latest() if base is None else base
        m = self.manifest(base)
        touched = self._touched(ids, m["buckets"])
        left = without(self._in(base, touched), ids, ID)
        v = self._write(base, left, touched, expect=self._held(base, touched))
        return v, m["rows"] - self.count(v)

    def replace(self, rows: DataFrame, meta: dict | None = None, schema: T.StructType | None = None, base: int | None = None) -> int:
        base = self.latest() if base is None else base
        return self._write(base, rows, None, meta, schema, rows.count())

    def delete_all(self) -> int:
        return self.replace(self.read().limit(0))

    def restore(self, version: int) -> int:
        """An old version's contents as the newest: only a manifest is written."""
        return self._commit(self.latest() + 1, self.manifest(version))

    def vacuum(self, keep: int = 10) -> int:
        """Forgets all but the newest versions and the files only they named."""
        every = self.versions()
        for v in every[:-keep]:
            self.files.delete(self._name(v))
        used = {p for v in every[-keep:] for p in self.manifest(v)["files"].values()}
        gone = [f"{d}/{b}" for d in self.files.names(f"{self.root}/data") for b in self.files.names(f"{self.root}/data/{d}") if b.startswith("_bucket=") and f"{d}/{b}" not in used]
        for p in gone:
            self.files.delete(f"{self.root}/data/{p}")
        return len(gone)
