"""Snapshot transactions over a store: queued operations, one commit."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentExists, DocumentNotFound, TransactionConflict, TransactionError
from ..sources.store import ID, VERSION, Store
from .changes import conflicts, last_operations, merged, overlay


class Isolation(Enum):
    READ_UNCOMMITTED = "readUncommitted"
    READ_COMMITTED = "readCommitted"
    REPEATABLE_READ = "repeatableRead"
    SERIALIZABLE = "serializable"

    @property
    def sees_snapshot(self) -> bool:
        return self in (Isolation.REPEATABLE_READ, Isolation.SERIALIZABLE)


class Transaction:
    """The snapshot is a pinned version number: nothing is copied."""

    def __init__(self, store: Store, isolation: Isolation = Isolation.READ_COMMITTED):
        self.store, self.isolation, self.base = store, isolation, store.latest()
        self.state, self._rows, self._read = "active", [], set()
        schema = store.read(self.base).schema
        self._schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *(f for f in schema if f.name != VERSION)])

    def _queue(self, op: str, id_: str, doc: dict | None = None) -> None:
        if self.state != "active":
            raise TransactionError(f"transaction is {self.state}")
        self._rows.append((len(self._rows), op, id_, doc or {}))

    def insert(self, id_: str, doc: dict) -> None:
        self._queue("insert", id_, doc)

    def update(self, id_: str, doc: dict) -> None:
        self._queue("update", id_, doc)

    def upsert(self, id_: str, doc: dict) -> None:
        self._queue("upsert", id_, doc)

    def delete(self, id_: str) -> None:
        self._queue("delete", id_)

    @property
    def operations(self) -> DataFrame:
        order = [f.name for f in self._schema][2:]
        rows = [(n, op, *((i if c == ID else d.get(c)) for c in order)) for n, op, i, d in self._rows]
        return self.store.spark.createDataFrame(rows, self._schema)

    def view(self) -> DataFrame:
        """All documents as this transaction sees them. Read-committed levels
        see the store as it is, and not their own pending operations."""
        if not self.isolation.sees_snapshot:
            return self.store.read().drop(VERSION)
        state = self.store.read(self.base).drop(VERSION)
        return overlay(state, self.operations.select("seq", "op", *state.columns), ID) if self._rows else state

    def get(self, id_: str) -> dict | None:
        self._read.add(id_)
        row = self.view().filter(F.col(ID) == id_).first()
        return row.asDict(recursive=True) if row else None

    def exists(self, id_: str) -> bool:
        return self.get(id_) is not None

    def commit(self) -> int:
        if self.state != "active":
            raise TransactionError(f"transaction is {self.state}")
        if not self._rows:
            self.state = "committed"
            return self.base
        now = self.store.latest()
        try:
            if self.isolation is Isolation.SERIALIZABLE and now != self.base and self._read:
                ids = self.store.spark.createDataFrame([(i,) for i in self._read], f"{ID} string")
                moved = conflicts(self.store.read(self.base).drop(VERSION), self.store.read(now).drop(VERSION), ids, ID)
                bad = [r[0] for r in moved.collect()]  # at most the ids read
                if bad:
                    raise TransactionConflict(bad)
            version = self._apply(now)
        except Exception:
            self.state = "failed"
            raise
        self.state = "committed"
        return version

    def _apply(self, base: int) -> int:
        ids = {i for _, _, i, _ in self._rows}
        there = {r[0] for r in self.store.read(base).filter(F.col(ID).isin(*ids)).select(ID).collect()}
        for _, op, i, _ in self._rows:
            if op == "insert" and i in there:
                raise DocumentExists(i)
            if op in ("update", "delete") and i not in there:
                raise DocumentNotFound(i)
            (there.discard if op == "delete" else there.add)(i)
        last = last_operations(self.operations, ID)
        n = self.store.manifest(base)["buckets"]
        touched = self.store._touched(last, n)
        old = self.store._in(base, touched)
        kept = old.join(last.filter("op = 'delete'").select(ID), ID, "left_anti")
        rows = merged(kept, last.filter("op <> 'delete'").drop("seq", "op"), ID, VERSION)
        return self.store._write(base, rows, touched, expect=self.store._held(base, touched) + len(self._rows))

    def rollback(self) -> None:
        if self.state == "active":
            self.state = "rolled back"
        self._rows.clear()


class Transactions:
    """At most one active transaction on a store."""

    def __init__(self, store: Store):
        self.store, self.current = store, None

    def begin(self, isolation: Isolation = Isolation.READ_COMMITTED) -> Transaction:
        if self.current is not None and self.current.state == "active":
            raise TransactionError("a transaction is active")
        self.current = Transaction(self.store, isolation)
        return self.current

    @contextmanager
    def scope(self, isolation: Isolation = Isolation.READ_COMMITTED) -> Iterator[Transaction]:
        t = self.begin(isolation)
        try:
            yield t
        except BaseException:
            t.rollback()
            raise
        if t.state == "active":
            t.commit()
