"""Results kept by table, predicate and the table's version.

The key holds which table it is and its version, so a write can't leave a stale
result behind and collections may share a cache; what is kept is a persisted
DataFrame, not rows on the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from .predicates import Predicate


@dataclass
class CacheStatistics:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    expirations: int = 0
    invalidations: int = 0

    @property
    def hit_ratio(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0

    def to_dict(self) -> dict:
        return asdict(self) | {"hit_ratio": self.hit_ratio}


class ResultCache:
    def __init__(self, most: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.enabled, self.statistics = True, CacheStatistics()
        self._kept: OrderedDict[tuple, tuple[float, DataFrame, frozenset]] = OrderedDict()

    def _drop(self, key: tuple) -> None:
        self._kept.pop(key)[1].unpersist()

    def get(self, p: Predicate, version: object = None, table: object = None) -> DataFrame | None:
        key = (p.key(), version, table)
        held = self._kept.get(key)
        if not self.enabled or held is None:
            self.statistics.misses += 1
            return None
        if self.clock() - held[0] > self.seconds:
            self._drop(key)
            self.statistics.expirations += 1
            self.statistics.misses += 1
            return None
        self._kept.move_to_end(key)
        self.statistics.hits += 1
        return held[1]

    def put(self, p: Predicate, df: DataFrame, version: object = None, table: object = None) -> DataFrame:
        if not self.enabled:
            return df
        key = (p.key(), version, table)
        if key in self._kept:
            self._drop(key)
        while len(self._kept) >= self.most:
            self._drop(next(iter(self._kept)))
            self.statistics.evictions += 1
        self._kept[key] = (self.clock(), df.persist(), frozenset(p.referenced()))
        return df

    def get_or(self, p: Predicate, make: Callable[[], DataFrame], version: object = None, table: object = None) -> DataFrame:
        found = self.get(p, version, table)
        return found if found is not None else self.put(p, make(), version, table)

    def __contains__(self, p: Predicate) -> bool:
        return any(k[0] == p.key() for k in self._kept)

    def __len__(self) -> int:
        return len(self._kept)

    def _invalidate(self, test) -> int:
        gone = [k for k, v in self._kept.items() if test(k, v)]
        for k in gone:
            self._drop(k)
        self.statistics.invalidations += len(gone)
        return len(gone)

    def invalidate(self, p: Predicate) -> int:
        return self._invalidate(lambda k, v: k[0] == p.key())

    def invalidate_table(self, table: object) -> int:
        return self._invalidate(lambda k, v: k[2] == table)

    def invalidate_fields(self, *names: str) -> int:
        """Also predicates that read no field, as any write may change them."""
        return self._invalidate(lambda k, v: not v[2] or v[2] & set(names))

    def remove_expired(self) -> int:
        gone = [k for k, v in self._kept.items() if self.clock() - v[0] > self.seconds]
        for k in gone:
            self._drop(k)
        self.statistics.expirations += len(gone)
        return len(gone)

    def clear(self) -> int:
        return self._invalidate(lambda k, v: True)
