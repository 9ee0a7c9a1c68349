"""Backups and migrations of several collections together."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.migrations import Migrator
from .snapshots import Snapshots
from .store import VERSION, Store

PRESETS = {
    "development": {"most": 3, "seconds": None, "compression": "none"},
    "production": {"most": 10, "seconds": 30 * 86400.0, "compression": "zstd"},
    "migration": {"most": 5, "seconds": None, "compression": "zstd"},
}


class Backups:
    """Of named stores (say data and users), each in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str, stores: dict[str, Store], preset: str = "production"):
        self.stores, self.how = stores, PRESETS[preset]
        self.of = {n: Snapshots(spark, f"{root}/{n}", compression=self.how["compression"]) for n in stores}

    def _each(self, make) -> dict[str, dict]:
        return {n: make(self.of[n], self.stores[n].read()) for n in self.stores}

    def full(self) -> dict[str, dict]:
        out = self._each(lambda s, df: s.full(df))
        for s in self.of.values():
            s.retain(self.how["most"], self.how["seconds"])
        return out

    def differential(self) -> dict[str, dict]:
        return self._each(lambda s, df: s.differential(df, s.latest("full")["name"]))

    def incremental(self) -> dict[str, dict]:
        return self._each(lambda s, df: s.incremental(df, s.latest()["name"]))

    def restore(self, names: dict[str, str] | None = None) -> dict[str, int]:
        """The newest snapshots, or given ones, as new versions of the stores."""
        done = {}
        for n, store in self.stores.items():
            name = (names or {}).get(n) or self.of[n].latest()["name"]
            state = self.of[n].state(name)
            done[n] = store.replace(state.select(*[c for c in store.read().columns if c in state.columns or c != VERSION]))
        return done

    def verify(self) -> dict[str, bool]:
        return {n: all(s.verify(c["name"]) for c in s.list()) for n, s in self.of.items()}


class Migrations:
    """Several migrators moved together; each store commits on its own."""

    def __init__(self, migrators: dict[str, Migrator]):
        self.migrators = migrators

    def migrate(self, target: str) -> dict[str, str]:
        before = {n: (m.store.latest(), m.version) for n, m in self.migrators.items()}
        try:
            for m in self.migrators.values():
                m.migrate(target)
        except Exception:
            for n, m in self.migrators.items():
                if m.version != before[n][1]:
                    m.store.restore(before[n][0])
            raise
        return {n: m.version for n, m in self.migrators.items()}
