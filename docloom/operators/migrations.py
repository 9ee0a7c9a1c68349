"""Schema migrations: DataFrame functions between versions of a store."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import MigrationError
from ..sources.store import ID, VERSION, Store

Step = Callable[[DataFrame], DataFrame]


def semver(v: str) -> tuple[int, ...]:
    try:
        parts = [int(x) for x in v.split(".")]
    except ValueError:
        raise MigrationError(f"not a version: {v}") from None
    return tuple(parts + [0] * (3 - len(parts)))


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Migration:
    """``up`` and ``down`` see all documents at once, so they may use windows."""

    source: str
    target: str
    up: Step = _same
    down: Step = _same
    note: str = ""
    check: Callable[[DataFrame], bool] = field(default=lambda df: True)


def add_default(name: str, value, source: str, target: str) -> Migration:
    def up(df):
        return df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))

    return Migration(source, target, up, lambda df: df.drop(name), f"add {name}")


def per_document(change: Callable[[dict], dict], source: str, target: str, back: Callable[[dict], dict] | None = None, schema: str | None = None, note: str = "") -> Migration:
    """A Python function of a document, for what columns can't express: Arrow
    batches of rows, no shuffle. ``schema``: of the new documents, if it differs."""

    def over(f):
        def step(df: DataFrame) -> DataFrame:
            def run(batches):
                for b in batches:
                    rows = [f(r) for r in b.to_pylist()]
                    yield pa.RecordBatch.from_pylist(rows, schema=want)

            out = T._parse_datatype_string(schema) if schema and f is change else df.schema
            want = to_arrow_schema(out)
            return df.mapInArrow(run, out)

        return step

    return Migration(source, target, over(change), over(back) if back else _same, note or "per document")


def rename(old: str, new: str, source: str, target: str) -> Migration:
    return Migration(source, target, lambda df: df.withColumnRenamed(old, new), lambda df: df.withColumnRenamed(new, old), f"rename {old} to {new}")


def path(migrations: Sequence[Migration], source: str, target: str) -> list[tuple[Migration, bool]]:
    """Steps (migration, up?) from one version to the other."""
    up = semver(target) >= semver(source)
    out, at = [], source
    while semver(at) != semver(target):
        here = [m for m in migrations if semver(m.source if up else m.target) == semver(at)]
        beyond = [m for m in here if (semver(at) < semver(m.target) <= semver(target) if up else semver(target) <= semver(m.source) < semver(at))]
        if not beyond:
            raise MigrationError(f"no way from {at} to {target}")
        best = max(beyond, key=lambda m: semver(m.target)) if up else min(beyond, key=lambda m: semver(m.source))
        out.append((best, up))
        at = best.target if up else best.source
    return out


class Migrator:
    """Runs migrations as one commit; a failure commits nothing."""

    def __init__(self, store: Store, migrations: Sequence[Migration], history: int = 100):
        self.store, self.migrations, self.history = store, list(migrations), history

    @property
    def version(self) -> str:
        return self.store.meta().get("schema_version", "0.0.0")

    def log(self) -> list[dict]:
        return self.store.meta().get("migrations", [])

    def _note(self, entry: dict) -> None:
        """An entry of the log alone: a new version of the same files."""
        m = self.store.manifest()
        log = [*self.log(), entry][-self.history :]
        self.store._commit(m["version"] + 1, m | {"meta": m["meta"] | {"migrations": log}})

    def migrate(self, target: str, dry_run: bool = False) -> DataFrame:
        source = self.version
        entry = {"from": source, "to": target, "steps": [], "time": time.time()}
        try:
            steps = path(self.migrations, source, target)
            df = self.store.read()
            for m, up in steps:
                entry["steps"].append(m.note or m.target)
                df = (m.up if up else m.down)(df)
                if ID not in df.columns:
                    raise MigrationError(f"{m.note or m.target} lost the ids")
                if not dry_run and not m.check(df):
                    raise MigrationError(f"check failed after {m.note or m.target}")
        except Exception as e:
            if not dry_run:
                self._note(entry | {"status": "failed", "error": str(e)[:500]})
            raise
        if dry_run:
            return df
        entry["status"] = "success" if steps else "skipped"
        if VERSION not in df.columns:
            df = df.withColumn(VERSION, F.lit(1).cast("long"))
        meta = {"schema_version": target, "migrations": [*self.log(), entry][-self.history :]}
        self.store.replace(df, meta, df.schema)
        return self.store.read()
