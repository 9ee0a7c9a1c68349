"""Key indexes: a field's values and the ids that have them, as a DataFrame.

Nulls aren't indexed. A ``btree`` index is laid out in key order (range
partitions, sorted files: min/max pruning answers ranges); a ``hash`` index
only answers equality."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedIndexType


@dataclass(frozen=True)
class KeyIndex:
    """``table``: rows (key, id)."""

    field: str
    kind: str
    table: DataFrame

    @classmethod
    def build(cls, df: DataFrame, field: str, kind: str = "btree", id_: str = "id") -> KeyIndex:
        if kind not in ("btree", "hash"):
            raise UnsupportedIndexType(kind)
        return cls(field, kind, df.select(F.col(field).alias("key"), F.col(id_).alias("id")).filter("key is not null"))

    # conditions

    def _sorted(self) -> None:
        if self.kind != "btree":
            raise UnsupportedIndexType(f"{self.kind} index on {self.field} has no order")

    def range_condition(self, low: Any = None, high: Any = None, with_low: bool = True, with_high: bool = False) -> Column:
        self._sorted()
        key, parts = F.col("key"), []
        if low is not None:
            parts.append(key >= F.lit(low) if with_low else key > F.lit(low))
        if high is not None:
            parts.append(key <= F.lit(high) if with_high else key < F.lit(high))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def ids(self, condition: Column) -> DataFrame:
        # a document has one key, so no id comes twice
        return self.table.filter(condition).select("id")

    # lookups

    def search(self, value: Any) -> DataFrame:
        return self.ids(F.lit(False) if value is None else F.col("key") == F.lit(value))

    def search_in(self, values) -> DataFrame:
        return self.ids(F.col("key").isin(*{v for v in values if v is not None}))

    def range_search(self, low=None, high=None, with_low=True, with_high=False) -> DataFrame:
        return self.ids(self.range_condition(low, high, with_low, with_high))

    def greater(self, value) -> DataFrame:
        return self.range_search(low=value, with_low=False)

    def at_least(self, value) -> DataFrame:
        return self.range_search(low=value)

    def less(self, value) -> DataFrame:
        return self.range_search(high=value)

    def at_most(self, value) -> DataFrame:
        return self.range_search(high=value, with_high=True)

    # counts, from one pass over the key column

    def count(self, condition: Column) -> int:
        return self.table.filter(condition).count()

    def count_equals(self, value) -> int:
        return self.count(F.col("key") == F.lit(value))

    def count_range(self, low=None, high=None, with_low=True, with_high=False) -> int:
        return self.count(self.range_condition(low, high, with_low, with_high))

    def exists_equals(self, value) -> bool:
        return not self.search(value).isEmpty()

    def exists_greater(self, value) -> bool:
        top = self.max_key()
        return top is not None and top > value

    def exists_less(self, value) -> bool:
        low = self.min_key()
        return low is not None and low < value

    def bounds(self) -> DataFrame:
        self._sorted()
        return self.table.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))

    def min_key(self):
        return self.bounds().first()[0]

    def max_key(self):
        return self.bounds().first()[1]

    def statistics(self, exact: bool = True) -> DataFrame:
        """One row: field, type, cardinality, entries, selectivity, entries a key."""
        distinct = F.count_distinct("key") if exact else F.approx_count_distinct("key")
        s = self.table.agg(distinct.alias("cardinality"), F.count("key").alias("total_entries"))
        some = F.col("cardinality") > 0
        return s.select(
            F.lit(self.field).alias("field"),
            F.lit(self.kind).alias("index_type"),
            "cardinality",
            "total_entries",
            F.when(some, 1 / F.col("cardinality")).otherwise(1.0).alias("selectivity"),
            F.when(some, F.col("total_entries") / F.col("cardinality")).otherwise(0.0).alias("entries_per_key"),
        )

    def key_count(self) -> int:
        return self.table.agg(F.count_distinct("key")).first()[0]

    def entry_count(self) -> int:
        return self.table.count()

    # storage

    def save(self, path: str, partitions: int | None = None) -> None:
        t = self.table
        if self.kind == "btree":
            args = ([partitions] if partitions else []) + ["key"]
            t = t.repartitionByRange(*args).sortWithinPartitions("key", "id")
        t.withColumn("_field", F.lit(self.field)).withColumn("_kind", F.lit(self.kind)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, field: str, kind: str) -> KeyIndex:
        return cls(field, kind, spark.read.parquet(path).select("key", "id"))
