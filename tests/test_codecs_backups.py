import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from enum import Enum
from urllib.parse import urlsplit

import pytest

from docloom.errors import MigrationError
from docloom.functions.codecs import Codec, Codecs, documents
from docloom.operators.migrations import Migration, Migrator, add_default
from docloom.sources.backups import Backups, Migrations
from docloom.sources.store import Store

SCHEMA = "id string, n long"


class Colour(Enum):
    RED = 1


@dataclass
class Thing:
    id: str
    wait: timedelta
    colours: set
    link: object = None


def test_codecs(spark):
    c = Codecs()
    assert c.encode(timedelta(seconds=2)) == 2_000_000 and c.decode("duration", 2_000_000) == timedelta(seconds=2)
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert c.encode(t) == "2024-01-01T00:00:00Z" and c.decode("instant", c.encode(t)) == t
    assert c.decode("uri", c.encode(urlsplit("http://x/y?z"))) == urlsplit("http://x/y?z")
    assert c.decode("pattern", c.encode(re.compile("a+", re.I))).match("AA") and c.decode("uri", None) is None
    assert c.encode({"a": [Colour.RED, {2, 1}], "b": 3}) == {"a": ["RED", [1, 2]], "b": 3}
    with pytest.raises(ValueError):
        c.register(Codec("uri", str, "string", str, str))
    assert c.unregister("uri") and "uri" not in c
    df = documents(spark, [Thing("a", timedelta(microseconds=5), {"y", "x"})], "id string, wait long, colours array<string>, link string")
    assert df.first().asDict() == {"id": "a", "wait": 5, "colours": ["x", "y"], "link": None}


def stores(spark, tmp_path):
    out = {}
    for n in ("data", "users"):
        out[n] = Store(spark, str(tmp_path / n), spark.createDataFrame([], SCHEMA).schema, 2)
        out[n].insert(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA))
    return out


def test_backups(spark, tmp_path):
    s = stores(spark, tmp_path)
    b = Backups(spark, str(tmp_path / "backup"), s)
    b.full()
    s["data"].delete(spark.createDataFrame([("a",)], "id string"))
    assert b.differential()["data"]["rows"] == 1 and b.incremental()["users"]["rows"] == 0
    s["data"].delete_all()
    b.restore()
    assert [r.id for r in s["data"].read().collect()] == ["b"] and s["users"].count() == 2 and all(b.verify().values())


def test_migrations_go_together(spark, tmp_path):
    s = stores(spark, tmp_path)

    def fail(df):
        raise MigrationError("no")

    with pytest.raises(MigrationError):
        Migrations({"data": Migrator(s["data"], [add_default("x", 1, "0.0.0", "1.0.0")]), "users": Migrator(s["users"], [Migration("0.0.0", "1.0.0", up=fail)])}).migrate("1.0.0")
    assert "x" not in s["data"].read().columns
    both = {n: Migrator(s[n], [add_default("x", 1, "0.0.0", "1.0.0")]) for n in s}
    assert Migrations(both).migrate("1.0.0") == {"data": "1.0.0", "users": "1.0.0"}
