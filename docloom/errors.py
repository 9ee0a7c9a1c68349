"""What can go wrong, by area."""

from __future__ import annotations


class DocloomError(Exception):
    """Base of all errors the engine raises on its own account."""


class StorageError(DocloomError): ...


class DocumentNotFound(StorageError): ...


class DocumentExists(StorageError): ...


class VersionConflict(StorageError):
    """A row, or the store, moved on since it was read."""


class CorruptSnapshot(StorageError): ...


class IndexError_(DocloomError): ...


class IndexExists(IndexError_): ...


class IndexMissing(IndexError_): ...


class UnsupportedIndexType(IndexError_): ...


class TransactionError(DocloomError): ...


class TransactionConflict(TransactionError):
    def __init__(self, ids):
        super().__init__(f"changed since the snapshot: {sorted(ids)}")
        self.ids = sorted(ids)


class MigrationError(DocloomError): ...


class TypeMismatch(DocloomError): ...


class AccessDenied(DocloomError): ...
