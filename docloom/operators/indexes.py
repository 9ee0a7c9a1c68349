"""All indexes of a collection, one per field."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..errors import IndexExists, IndexMissing, UnsupportedIndexType
from ..functions.text import TextConfig
from ..sources.files import Files
from .keyindex import KeyIndex
from .textindex import TextIndex


class Indexes:
    def __init__(self) -> None:
        self._by_field: dict[str, KeyIndex | TextIndex] = {}

    def create(self, df: DataFrame, field: str, kind: str = "btree", id_: str = "id", config: TextConfig | None = None):
        if field in self._by_field:
            raise IndexExists(field)
        made = TextIndex.build(df, field, id_, config) if kind == "fulltext" else KeyIndex.build(df, field, kind, id_)
        self._by_field[field] = made
        return made

    def remove(self, field: str) -> None:
        if self._by_field.pop(field, None) is None:
            raise IndexMissing(field)

    def rebuild(self, df: DataFrame, id_: str = "id") -> None:
        for name, old in list(self._by_field.items()):
            self._by_field[name] = TextIndex.build(df, name, id_, old.config) if isinstance(old, TextIndex) else KeyIndex.build(df, name, old.kind, id_)

    def get(self, field: str) -> KeyIndex | TextIndex:
        if field not in self._by_field:
            raise IndexMissing(field)
        return self._by_field[field]

    def key(self, field: str) -> KeyIndex:
        found = self.get(field)
        if not isinstance(found, KeyIndex):
            raise UnsupportedIndexType(f"{field} has a full-text index")
        return found

    def text(self, field: str) -> TextIndex:
        found = self.get(field)
        if not isinstance(found, TextIndex):
            raise UnsupportedIndexType(f"{field} has a {found.kind} index")
        return found

    def kind(self, field: str) -> str | None:
        found = self._by_field.get(field)
        return None if found is None else "fulltext" if isinstance(found, TextIndex) else found.kind

    def has(self, field: str, kind: str | None = None) -> bool:
        return field in self._by_field and (kind is None or self.kind(field) == kind)

    @property
    def fields(self) -> list[str]:
        return sorted(self._by_field)

    def clear(self) -> None:
        self._by_field.clear()

    def save(self, root: str, spark: SparkSession | None = None, version: int | None = None) -> list[str]:
        """Every index, and a list of them that says which version they are of."""
        for name, index in self._by_field.items():
            index.save(f"{root}/{name}.{self.kind(name)}")
        if spark is not None:
            files, card = Files(spark), f"{root}/indexes.json"
            files.delete(card)
            files.create(card, json.dumps({"version": version, "kinds": {n: self.kind(n) for n in self.fields}}))
        return self.fields

    def load_all(self, spark: SparkSession, root: str, version: int | None = None) -> list[str]:
        """The saved indexes, if they are of that version (None: of any)."""
        files, card = Files(spark), f"{root}/indexes.json"
        if not files.exists(card):
            return []
        saved = json.loads(files.read(card))
        if version is not None and saved["version"] != version:
            return []
        for field, kind in saved["kinds"].items():
            self.load(spark, root, field, kind)
        return sorted(saved["kinds"])

    def load(self, spark, root: str, field: str, kind: str, config: TextConfig | None = None):
        path = f"{root}/{field}.{kind}"
        made = TextIndex.load(spark, path, field, config) if kind == "fulltext" else KeyIndex.load(spark, path, field, kind)
        self._by_field[field] = made
        return made
