"""Python values that Spark has no type for, as values that it has.

A codec names a Python type, the Spark type that stores it, and the two
conversions. They run on the driver, for documents that are built from Python
objects; on columns, ``duration`` and its kin are ordinary expressions."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from enum import Enum
from typing import Any
from urllib.parse import SplitResult, urlsplit

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Codec:
    name: str
    type_: type
    spark_type: str
    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]


def _instant(d: datetime) -> str:
    return d.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


BUILTIN = (
    Codec("duration", timedelta, "bigint", lambda d: d // timedelta(microseconds=1), lambda n: timedelta(microseconds=n)),
    Codec("instant", datetime, "string", _instant, lambda s: datetime.fromisoformat(s.replace("Z", "+00:00"))),
    Codec("uri", SplitResult, "string", lambda u: u.geturl(), urlsplit),
    Codec("integer", int, "decimal(38,0)", int, int),
    Codec("pattern", re.Pattern, "struct<pattern:string,flags:int>", lambda p: (p.pattern, p.flags), lambda r: re.compile(r[0], r[1])),
)


class Codecs:
    """A registry; types that aren't in it pass unchanged."""

    def __init__(self, codecs: Iterable[Codec] = BUILTIN):
        self._by_name: dict[str, Codec] = {}
        for c in codecs:
            self.register(c)

    def register(self, c: Codec) -> None:
        if c.name in self._by_name:
            raise ValueError(f"codec {c.name} is registered")
        self._by_name[c.name] = c

    def unregister(self, name: str) -> bool:
        return self._by_name.pop(name, None) is not None

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def named(self, name: str) -> Codec:
        return self._by_name[name]

    def encode(self, value: Any) -> Any:
        if isinstance(value, Enum):
            return value.name
        for c in self._by_name.values():
            if isinstance(value, c.type_) and c.type_ is not int:
                return c.encode(value)
        if isinstance(value, (set, frozenset)):
            return sorted(map(self.encode, value))
        if isinstance(value, (list, tuple)):
            return [self.encode(v) for v in value]
        if isinstance(value, dict):
            return {k: self.encode(v) for k, v in value.items()}
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return self.encode({f.name: getattr(value, f.name) for f in dataclasses.fields(value)})
        return value

    def decode(self, name: str, value: Any) -> Any:
        return None if value is None else self._by_name[name].decode(value)


def decoded(rows: Iterable[Any], make: Callable[..., Any], codecs: Codecs | None = None, kinds: dict[str, str] | None = None) -> Iterator[Any]:
    """Objects of rows: the reverse of :func:`documents`. Fields that ``make``,
    if it is a dataclass, doesn't have are left out."""
    codecs, kinds = codecs or Codecs(), kinds or {}
    wanted = {f.name for f in dataclasses.fields(make)} if dataclasses.is_dataclass(make) else None
    for r in rows:
        values = r.asDict(recursive=True)
        yield make(**{k: codecs.decode(kinds[k], v) if k in kinds else v for k, v in values.items() if wanted is None or k in wanted})


def documents(spark: SparkSession, objects: Iterable[Any], schema: str, codecs: Codecs | None = None) -> DataFrame:
    """Dataclass instances or dicts as rows of ``schema``."""
    codecs = codecs or Codecs()
    rows = [codecs.encode(o) for o in objects]
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
