"""A collection: a store or DataFrame with finders, counts, indexes, caching.

Finders compile predicates to one Catalyst filter; access paths are Catalyst's
business. Counts and existence are aggregates over the predicate's columns, or
over a key index that can answer them. Indexes follow every write."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentNotFound, IndexMissing, StorageError
from ..functions.codecs import Codecs, decoded
from ..plans import predicates as P
from ..plans.builder import Where
from ..plans.cache import ResultCache
from ..plans.compiler import compile_predicate
from ..sources.store import ID, VERSION, Store
from .indexes import Indexes
from .keyindex import KeyIndex


def _tree(p: P.Predicate | Where | None) -> P.Predicate:
    return P.All() if p is None else p.build_or_all() if isinstance(p, Where) else p


def find(df: DataFrame, p: P.Predicate | Where | None, variant: str | None = None) -> DataFrame:
    tree = _tree(p)
    return df if isinstance(tree, P.All) else df.filter(compile_predicate(tree, df, variant))


def count_where(df: DataFrame, p: P.Predicate | Where | None = None, variant: str | None = None) -> DataFrame:
    """One row, ``n``."""
    return find(df, p, variant).agg(F.count("*").alias("n"))


def exists_where(df: DataFrame, p: P.Predicate | Where, variant: str | None = None) -> DataFrame:
    """One row, ``found``; the scan stops at the first hit."""
    return find(df, p, variant).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("found"))


@dataclass(frozen=True)
class CollectionConfig:
    """How a collection is kept: the id's column, a VARIANT column for fields
    without one of their own, cached results (how many, for how long), buckets,
    compression and encryption key of its store."""

    id: str = ID
    variant: str | None = None
    cached: int = 0
    seconds: float = 300.0
    buckets: int = 8
    compression: str = "zstd"
    key: bytes | None = None

    def cache(self) -> ResultCache | None:
        return ResultCache(self.cached, self.seconds) if self.cached else None


#: Predicates that a key index answers, as nulls don't satisfy them.
_BY_KEY = {"btree": (P.Equals, P.Greater, P.GreaterOrEqual, P.Less, P.LessOrEqual, P.Between, P.In), "hash": (P.Equals, P.In)}


class Collection:
    def __init__(self, source: Store | DataFrame, id_: str = ID, variant: str | None = None, cache: ResultCache | None = None):
        self.source, self.id, self.variant = source, id_, variant
        self._indexes, self.cache = Indexes(), cache
        self._indexed = self.version

    @property
    def indexes(self) -> Indexes:
        """As of the newest version: rebuilt, which reads nothing yet, if there
        was a write since."""
        now = self.version
        if now != self._indexed:
            self._indexed = now
            if self._indexes.fields:
                self._indexes.rebuild(self.df, self.id)
        return self._indexes

    @property
    def table(self) -> str:
        """Which table it is, for a cache that several collections share."""
        return self.source.root if isinstance(self.source, Store) else f"frame {self.source.semanticHash()} {id(self.source)}"

    # cached results

    def enable_cache(self, most: int = 100, seconds: float = 300.0) -> None:
        if self.cache is None:
            self.cache = ResultCache(most, seconds)
        self.cache.enabled = True

    def disable_cache(self) -> None:
        """What is kept is forgotten."""
        if self.cache is not None:
            self.cache.invalidate_table(self.table)
            self.cache.enabled = False

    def clear_cache(self) -> int:
        return 0 if self.cache is None else self.cache.invalidate_table(self.table)

    def prune_cache(self) -> int:
        return 0 if self.cache is None else self.cache.remove_expired()

    @property
    def version(self) -> int | None:
        return self.source.latest() if isinstance(self.source, Store) else None

    @property
    def df(self) -> DataFrame:
        return self.source.read() if isinstance(self.source, Store) else self.source

    def __len__(self) -> int:
        return self.source.count() if isinstance(self.source, Store) else self.source.count()

    # writing

    def _store(self) -> Store:
        if not isinstance(self.source, Store):
            raise StorageError("a collection over a DataFrame is read-only")
        return self.source

    def _rows(self, docs: DataFrame | dict | Sequence[dict]) -> DataFrame:
        if isinstance(docs, DataFrame):
            return docs
        docs = [docs] if isinstance(docs, dict) else list(docs)
        schema = T.StructType([f for f in self.df.schema if f.name != VERSION])
        return self._store().spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in docs], schema)

    def insert(self, docs: DataFrame | dict | Sequence[dict]) -> int:
        """New documents, all or none; those without an id get one."""
        return self._store().insert(self._rows(docs))

    def update(self, docs: DataFrame | dict | Sequence[dict]) -> int:
        return self._store().update(self._rows(docs))

    def upsert(self, docs: DataFrame | dict | Sequence[dict]) -> int:
        return self._store().upsert(self._rows(docs))

    def update_where(self, p: P.Predicate | Where, assignments: dict) -> int:
        """Sets columns to expressions of the row, in all matches at once."""
        return self._store().update_where(compile_predicate(_tree(p), self.df, self.variant), assignments)

    def delete(self, *ids: str) -> int:
        """How many of the ids there were."""
        return self._store().delete(self._store().spark.createDataFrame([(i,) for i in ids], f"{ID} string"))[1]

    def delete_or_raise(self, id_: str) -> None:
        if not self.delete(id_):
            raise DocumentNotFound(id_)

    def delete_where(self, p: P.Predicate | Where) -> int:
        return self._store().delete(self.find(p, bypass_cache=True).select(ID))[1]

    def delete_all(self) -> int:
        n = len(self)
        self._store().delete_all()
        return n

    def dispose(self) -> None:
        self._indexes.clear()
        self.clear_cache()

    # by id

    def get(self, id_) -> Row | None:
        df = self.source.get(id_) if isinstance(self.source, Store) and self.id == ID else self.df.filter(F.col(self.id) == id_)
        return df.limit(1).first()

    def get_or_raise(self, id_) -> Row:
        row = self.get(id_)
        if row is None:
            raise DocumentNotFound(str(id_))
        return row

    def exists(self, id_) -> bool:
        return self.get(id_) is not None

    def get_many(self, ids: Sequence | DataFrame) -> DataFrame:
        """Those found. Of a list, in its order; of a DataFrame, by a semi-join."""
        if isinstance(ids, DataFrame):
            return self.df.join(ids.select(F.col(ids.columns[0]).alias(self.id)).distinct(), self.id, "left_semi")
        ids = list(dict.fromkeys(ids))
        place = F.array_position(F.array(*map(F.lit, ids)), F.col(self.id)) if ids else F.lit(0)
        return self.df.filter(F.col(self.id).isin(*ids)).orderBy(place)

    def objects(self, make: Callable[..., Any], codecs: Codecs | None = None, kinds: dict[str, str] | None = None) -> Iterator[Any]:
        """All documents as objects: ``make`` gets a row's fields by name, those
        in ``kinds`` (field: codec) decoded. A partition at a time."""
        return decoded(self.stream(), make, codecs, kinds)

    def stream(self) -> Iterator[Row]:
        return self.df.toLocalIterator(prefetchPartitions=True)

    # by predicate

    def find(self, p: P.Predicate | Where | None = None, bypass_cache: bool = False) -> DataFrame:
        tree = _tree(p)
        if self.cache is None:
            return find(self.df, tree, self.variant)
        version = self.version
        held = None if bypass_cache else self.cache.get(tree, version, self.table)
        return held if held is not None else self.cache.put(tree, find(self.df, tree, self.variant), version, self.table)

    def find_one(self, p: P.Predicate | Where | None = None) -> Row | None:
        """The match with the least id."""
        return self.find(p).orderBy(self.id).limit(1).first()

    def find_one_or_raise(self, p: P.Predicate | Where | None = None) -> Row:
        row = self.find_one(p)
        if row is None:
            raise DocumentNotFound(_tree(p).tree())
        return row

    def count_where(self, p: P.Predicate | Where | None = None) -> int:
        tree = _tree(p)
        if isinstance(tree, P.All):
            return len(self)
        keys = self._keys(tree)
        return keys.count() if keys is not None else count_where(self.df, tree, self.variant).first()[0]

    def exists_where(self, p: P.Predicate | Where) -> bool:
        keys = self._keys(_tree(p))
        return not (keys if keys is not None else find(self.df, p, self.variant).select(F.lit(1))).limit(1).isEmpty()

    def _keys(self, tree: P.Predicate) -> DataFrame | None:
        """The matching entries of a key index that can answer ``tree``."""
        name = getattr(tree, "field", None)
        index = self.indexes.get(name) if name and self.indexes.has(name) else None
        if not isinstance(index, KeyIndex) or type(tree) not in _BY_KEY[index.kind]:
            return None
        if None in (getattr(tree, "value", 0), getattr(tree, "low", 0), getattr(tree, "high", 0), *getattr(tree, "values", ())):
            return None
        return index.table.filter(compile_predicate(replace(tree, field="key"), index.table))

    def explain(self, p: P.Predicate | Where) -> dict:
        """The tree, the index that serves it best, and Spark's plan."""
        tree = _tree(p)
        fields = sorted(tree.referenced())
        df = find(self.df, tree, self.variant)
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return {"tree": tree.tree(), "fields": fields, "indexed": [f for f in fields if self.indexes.has(f)], "pushed": [ln.strip() for ln in plan.splitlines() if "PushedFilters" in ln], "plan": plan}

    # indexes

    def create_index(self, field: str, kind: str = "btree", **how):
        return self.indexes.create(self.df, field, kind, self.id, **how)

    def save_indexes(self, root: str) -> list[str]:
        """All of them, with the version they are of."""
        return self.indexes.save(root, self._store().spark, self.version)

    def load_indexes(self, root: str) -> list[str]:
        """Those saved from the newest version; others would be stale."""
        found = self._indexes.load_all(self._store().spark, root, self.version)
        self._indexed = self.version
        return found

    def remove_index(self, field: str) -> None:
        self.indexes.remove(field)

    def rebuild_indexes(self) -> None:
        self.indexes.rebuild(self.df, self.id)

    def by_index(self, ids: DataFrame) -> DataFrame:
        """The documents of an index lookup."""
        return self.df.join(ids.withColumnRenamed("id", self.id), self.id, "left_semi")

    def index_statistics(self) -> DataFrame:
        found = [self.indexes.get(f) for f in self.indexes.fields]
        rows = [i.statistics() for i in found if isinstance(i, KeyIndex)]
        if not rows:
            raise IndexMissing("no key index")
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out
