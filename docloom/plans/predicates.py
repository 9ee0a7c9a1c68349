"""The predicate language: immutable trees with a wire format.

A tree says what a document must satisfy; compiler.py turns it into a Column.
Missing fields count as null everywhere but in :class:`Exists`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from datetime import date, datetime
from typing import Any, ClassVar

_BY_NAME: dict[str, type[Predicate]] = {}


@dataclass(frozen=True)
class Predicate:
    """A node. ``WIRE`` is its name on the wire, ``KEYS`` its keys there."""

    WIRE: ClassVar[str] = ""
    KEYS: ClassVar[Mapping[str, str]] = {}

    def __init_subclass__(cls, wire: str = "", keys: Mapping[str, str] | None = None, **kw):
        super().__init_subclass__(**kw)
        if wire:
            cls.WIRE, cls.KEYS = wire, keys or {}
            _BY_NAME[wire] = cls

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def to_dict(self) -> dict[str, Any]:
        def plain(v):
            if isinstance(v, Predicate):
                return v.to_dict()
            return [plain(x) for x in v] if isinstance(v, tuple) else v

        return {"type": self.WIRE} | {self.KEYS.get(f.name, f.name): plain(getattr(self, f.name)) for f in fields(self)}

    @staticmethod
    def from_dict(node: Mapping[str, Any]) -> Predicate:
        kind = _BY_NAME.get(node.get("type") or "")
        if kind is None:
            raise ValueError(f"unknown predicate type {node.get('type')!r}")
        args = {}
        for f in fields(kind):
            key = kind.KEYS.get(f.name, f.name)
            if key in node:
                v = node[key]
                if f.name == "parts":
                    v = tuple(map(Predicate.from_dict, v))
                elif f.name == "inner":
                    v = Predicate.from_dict(v)
                elif f.name in ("values", "terms"):
                    v = tuple(v)
                args[f.name] = v
        return kind(**args)

    def referenced(self) -> set[str]:
        """The fields the predicate reads."""
        own = {self.field} if hasattr(self, "field") else set()
        for child in getattr(self, "parts", ()):
            own |= child.referenced()
        return own | (self.inner.referenced() if hasattr(self, "inner") else set())

    def key(self) -> str:
        """A canonical form that keeps 1, 1.0, true and "1" apart."""
        return json.dumps(self.to_dict(), sort_keys=True, default=lambda v: {"$" + type(v).__name__: v.isoformat() if isinstance(v, (date, datetime)) else repr(v)})

    def tree(self, indent: int = 0) -> str:
        head = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("parts", "inner")}
        lines = ["  " * indent + type(self).__name__ + (f" {head}" if head else "")]
        lines += [c.tree(indent + 1) for c in (*getattr(self, "parts", ()), *([self.inner] if hasattr(self, "inner") else []))]
        return "\n".join(lines)


@dataclass(frozen=True)
class All(Predicate, wire="AllQuery"):
    """Every document."""


@dataclass(frozen=True)
class _Value(Predicate):
    field: str
    value: Any


class Equals(_Value, wire="EqualsQuery"): ...


class NotEquals(_Value, wire="NotEqualsQuery"): ...


class Greater(_Value, wire="GreaterThanQuery"): ...


class GreaterOrEqual(_Value, wire="GreaterThanOrEqualsQuery"): ...


class Less(_Value, wire="LessThanQuery"): ...


class LessOrEqual(_Value, wire="LessThanOrEqualsQuery"): ...


@dataclass(frozen=True)
class Between(Predicate, wire="BetweenQuery", keys={"low": "lowerBound", "high": "upperBound", "with_low": "includeLower", "with_high": "includeUpper"}):
    field: str
    low: Any
    high: Any
    with_low: bool = True
    with_high: bool = True

    def __post_init__(self):
        if self.low is None or self.high is None:
            raise ValueError("a bound is null; use one-sided comparisons")


@dataclass(frozen=True)
class _Values(Predicate):
    field: str
    values: tuple

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))


class In(_Values, wire="InQuery"): ...


class NotIn(_Values, wire="NotInQuery"): ...


@dataclass(frozen=True)
class _Several(Predicate):
    parts: tuple[Predicate, ...]

    def __post_init__(self):
        object.__setattr__(self, "parts", tuple(self.parts))
        if not self.parts:
            raise ValueError(f"{type(self).__name__} of nothing")


class And(_Several, wire="AndQuery", keys={"parts": "queries"}): ...


class Or(_Several, wire="OrQuery", keys={"parts": "queries"}): ...


@dataclass(frozen=True)
class Not(Predicate, wire="NotQuery", keys={"inner": "query"}):
    inner: Predicate


@dataclass(frozen=True)
class Matches(Predicate, wire="RegexQuery", keys={"case": "caseSensitive", "lines": "multiLine"}):
    field: str
    pattern: str
    case: bool = True
    lines: bool = False


@dataclass(frozen=True)
class _Field(Predicate):
    field: str


class Exists(_Field, wire="ExistsQuery"): ...


class IsNull(_Field, wire="IsNullQuery"): ...


class IsNotNull(_Field, wire="IsNotNullQuery"): ...


@dataclass(frozen=True)
class Contains(Predicate, wire="ContainsQuery", keys={"case": "caseSensitive"}):
    field: str
    value: Any
    case: bool = True


@dataclass(frozen=True)
class StartsWith(Predicate, wire="StartsWithQuery", keys={"case": "caseSensitive"}):
    field: str
    prefix: str
    case: bool = True


@dataclass(frozen=True)
class EndsWith(Predicate, wire="EndsWithQuery", keys={"case": "caseSensitive"}):
    field: str
    suffix: str
    case: bool = True


@dataclass(frozen=True)
class TextAll(Predicate, wire="FullTextQuery", keys={"text": "searchText", "case": "caseSensitive"}):
    field: str
    text: str
    case: bool = False


@dataclass(frozen=True)
class TextPhrase(Predicate, wire="FullTextPhraseQuery", keys={"case": "caseSensitive"}):
    field: str
    phrase: str
    case: bool = False


@dataclass(frozen=True)
class TextAny(Predicate, wire="FullTextAnyQuery", keys={"case": "caseSensitive"}):
    field: str
    terms: tuple[str, ...]
    case: bool = False

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(self.terms))


@dataclass(frozen=True)
class TextPrefix(Predicate, wire="FullTextPrefixQuery", keys={"case": "caseSensitive"}):
    field: str
    prefix: str
    case: bool = False


@dataclass(frozen=True)
class TextNear(Predicate, wire="FullTextProximityQuery", keys={"distance": "maxDistance", "case": "caseSensitive"}):
    field: str
    terms: tuple[str, ...]
    distance: int
    case: bool = False

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(self.terms))


def conjunction(parts: Sequence[Predicate]) -> Predicate:
    return And(tuple(parts)) if len(parts) > 1 else parts[0] if parts else All()
