"""Named collections under one root, and their statistics."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .errors import StorageError, TypeMismatch
from .operators.collection import Collection, CollectionConfig
from .sources.files import Files
from .sources.store import VERSION, Store

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}")
_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")
_FIELD = re.compile(r"[^$].{0,63}", re.S)


def valid_name(s: str) -> bool:
    return bool(_NAME.fullmatch(s))


def valid_id(s: str) -> bool:
    return bool(_ID.fullmatch(s))


def valid_field(s: str) -> bool:
    return bool(_FIELD.fullmatch(s))


class Database:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._open: dict[str, Collection] = {}

    def collection(self, name: str, schema: T.StructType | str | None = None, cache: bool = False, config: CollectionConfig | None = None) -> Collection:
        config = config or CollectionConfig(cached=100 * cache, buckets=self.buckets)
        if not valid_name(name):
            raise StorageError(f"not a collection name: {name!r}")
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if name not in self._open:
            store = Store(self.spark, f"{self.root}/{name}", schema, config.buckets, config.compression, key=config.key)
            self._open[name] = Collection(store, config.id, config.variant, config.cache())
        held = self._open[name]
        if schema is not None:
            have = {f.name: f.dataType for f in held.df.schema if f.name != VERSION}
            want = {f.name: f.dataType for f in schema if f.name != VERSION}
            if have != want:
                raise TypeMismatch(f"{name} has other columns: {have}")
        return held

    def names(self) -> list[str]:
        return [n for n in Files(self.spark).names(self.root) if valid_name(n)]

    def drop(self, name: str) -> None:
        self._open.pop(name, None)
        Files(self.spark).delete(f"{self.root}/{name}")

    def statistics(self) -> dict[str, dict]:
        return {n: {"documents": len(c := self.collection(n)), "indexes": len(c.indexes.fields), "version": c.version} for n in self.names()}
