"""Backups: full, differential and incremental snapshots with digests."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptSnapshot
from ..operators.changes import changes, digest, replay
from .files import Files


class Snapshots:
    """Of one collection, in a folder: data as Parquet, a JSON card each.

    An incremental snapshot differs from the *state* its predecessor stands
    for, not from that file's rows, so chains replay exactly."""

    def __init__(self, spark: SparkSession, root: str, id_: str = "id", compression: str = "zstd"):
        self.spark, self.root, self.id, self.files, self.compression = spark, root.rstrip("/"), id_, Files(spark), compression

    def _save(self, df: DataFrame, kind: str, base: str | None) -> dict:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", self.compression).parquet(f"{self.root}/{name}")
        rows, check = digest(self.spark.read.parquet(f"{self.root}/{name}"), self.id)
        card = {"name": name, "kind": kind, "base": base, "rows": rows, "digest": check, "time": time.time()}
        self.files.create(f"{self.root}/{name}.json", json.dumps(card))
        return card

    def full(self, df: DataFrame) -> dict:
        return self._save(df, "full", None)

    def differential(self, df: DataFrame, base: str) -> dict:
        if self.card(base)["kind"] != "full":
            raise CorruptSnapshot(f"{base} isn't a full snapshot")
        return self._save(changes(self.data(base), df, self.id), "differential", base)

    def incremental(self, df: DataFrame, previous: str) -> dict:
        return self._save(changes(self.state(previous), df, self.id), "incremental", previous)

    def card(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.root}/{name}.json"))

    def data(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def chain(self, name: str) -> list[dict]:
        out = [self.card(name)]
        while out[0]["base"]:
            out.insert(0, self.card(out[0]["base"]))
        return out

    def state(self, name: str) -> DataFrame:
        """What the collection was at that snapshot."""
        first, *rest = self.chain(name)
        if first["kind"] != "full":
            raise CorruptSnapshot(f"the chain of {name} doesn't begin with a full snapshot")
        return replay(self.data(first["name"]), [self.data(c["name"]) for c in rest], self.id)

    def restore(self, names: list[str]) -> DataFrame:
        """Replays given snapshots in order; a full one among them starts anew."""
        cards = [self.card(n) for n in names]
        if not cards or cards[0]["kind"] != "full":
            raise CorruptSnapshot("a chain begins with a full snapshot")
        last = max(k for k, c in enumerate(cards) if c["kind"] == "full")
        return replay(self.data(names[last]), [self.data(n) for n in names[last + 1 :]], self.id)

    def verify(self, name: str) -> bool:
        card = self.card(name)
        return digest(self.data(name), self.id) == (card["rows"], card["digest"])

    def list(self) -> list[dict]:
        """Newest first."""
        return [self.card(n[:-5]) for n in reversed(self.files.names(self.root)) if n.endswith(".json")]

    def latest(self, kind: str | None = None) -> dict | None:
        return next((c for c in self.list() if kind in (None, c["kind"])), None)

    def delete(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}.json")
        self.files.delete(f"{self.root}/{name}")

    def retain(self, most: int | None = None, seconds: float | None = None, now: float | None = None) -> list[str]:
        """Drops what is too old, then what is too many; never a snapshot that
        one of the kept builds on."""
        cards = self.list()
        now = time.time() if now is None else now
        kept = [c for c in cards if seconds is None or now - c["time"] <= seconds][:most]
        needed = {c["name"] for k in kept for c in self.chain(k["name"])}
        gone = [c["name"] for c in cards if c["name"] not in needed]
        for n in gone:
            self.delete(n)
        return gone


def statistics(df: DataFrame) -> dict:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return {"rows": n, "json_bytes": size, "mean_bytes": size / n if n else 0.0}
