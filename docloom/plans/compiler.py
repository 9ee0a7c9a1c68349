"""Predicates to Columns.

Predicates are two-valued; SQL is three-valued. Negations are therefore pushed
down to the leaves, each of which has a positive and a negated form that is
never null: ``not (x > 5)`` becomes ``x is null or x <= 5``. Both forms reach
the Parquet scan as pushed filters, which a ``coalesce(..., false)`` wouldn't.
Literals are checked against the column's type here, as ANSI casts would fail
at run time: what can't compare is never equal, greater or less.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import driver_tokens, folded, regex_flags, split_tokens
from . import predicates as P

PRESENT = "__present"


class Field:
    """A resolved path: its column and type (None: no such field)."""

    def __init__(self, column: Column | None, kind: T.DataType | None, variant: tuple[Column, str] | None = None):
        self.column, self.kind, self.variant = column, kind, variant

    def typed(self, value: Any) -> tuple[Column, T.DataType] | None:
        """The column to compare with ``value``, or None if they can't be."""
        if self.variant:
            name = _variant_type(value)
            if name is None:
                return None
            return F.try_variant_get(self.variant[0], self.variant[1], name), _TYPES[name]
        return (self.column, self.kind) if self.kind is not None and comparable(self.kind, value) else None


_TYPES: dict[str, T.DataType] = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _variant_type(value: Any) -> str | None:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "double"
    return "string" if isinstance(value, str) else "timestamp" if isinstance(value, datetime) else None


def comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (datetime, date)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(value, (bytes, bytearray)):
        return isinstance(kind, T.BinaryType)
    if isinstance(value, (list, tuple)):
        return isinstance(kind, T.ArrayType) and all(v is None or comparable(kind.elementType, v) for v in value)
    if isinstance(value, dict):
        if isinstance(kind, T.MapType):
            return all(v is None or comparable(kind.valueType, v) for v in value.values())
        return isinstance(kind, T.StructType) and set(value) <= set(kind.names) and all(v is None or comparable(kind[k].dataType, v) for k, v in value.items())
    return False


def literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return (F.array(*(literal(v, kind.elementType) for v in value)) if value else F.array()).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(literal(value.get(f.name), f.dataType).alias(f.name) for f in kind))
    if isinstance(kind, T.MapType):
        pairs = [x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast(kind)
    if isinstance(value, datetime) and not isinstance(kind, T.DateType):
        return F.lit(value).cast(kind)
    return F.lit(bytes(value)) if isinstance(value, bytearray) else F.lit(value)


def _no_maps(c: Column, kind: T.DataType) -> Column:
    """Maps don't compare; their sorted entries do."""
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


class Compiler:
    def __init__(self, schema: T.StructType, variant: str | None = None):
        """``variant``: a VARIANT column that holds all fields that aren't
        columns of their own."""
        self.schema, self.variant = schema, variant

    def field(self, path: str) -> Field:
        kind: T.DataType = self.schema
        names = path.split(".")
        for i, name in enumerate(names):
            if isinstance(kind, T.StructType) and name in kind.names:
                kind = kind[name].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                at = F.col(".".join(f"`{n}`" for n in names[:i]))
                rest = names[i:]
                for r in rest:
                    if not isinstance(kind, T.MapType):
                        return Field(None, None)
                    at, kind = F.try_element_at(at, F.lit(r)), kind.valueType
                return Field(at, kind)
            elif isinstance(kind, T.VariantType):
                return Field(None, None, (F.col(".".join(f"`{n}`" for n in names[:i])), "$." + ".".join(names[i:])))
            elif i == 0 and self.variant:
                return Field(None, None, (F.col(f"`{self.variant}`"), "$." + path))
            else:
                return Field(None, None)
        return Field(F.col(".".join(f"`{n}`" for n in names)), kind)

    def column(self, p: P.Predicate, negated: bool = False) -> Column:
        return getattr(self, "_" + type(p).__name__)(p, negated)

    # leaves

    def _leaf(self, f: Field, value: Any, negated: bool, yes: Callable, no: Callable, same: bool = False) -> Column:
        found = f.typed(value)
        if found is None:
            return F.lit(negated)
        c, kind = found
        if same:
            c_, v = _no_maps(c, kind), _no_maps(literal(value, kind), kind)
        else:
            c_, v = c, literal(value, kind)
        return c.isNull() | no(c_, v) if negated else yes(c_, v)

    def _is_null(self, f: Field, negated: bool) -> Column:
        if f.variant:
            got = F.variant_get(f.variant[0], f.variant[1], "variant")
            null = got.isNull() | F.is_variant_null(got)
            return F.coalesce(~null, F.lit(False)) if negated else F.coalesce(null, F.lit(True))
        if f.column is None:
            return F.lit(not negated)
        return f.column.isNotNull() if negated else f.column.isNull()

    def _All(self, p, negated):
        return F.lit(not negated)

    def _Equals(self, p, negated):
        f = self.field(p.field)
        if p.value is None:
            return self._is_null(f, negated)
        if f.kind is not None and isinstance(f.kind, (T.ArrayType, T.StructType)) and comparable(f.kind, p.value):
            # elements may be null on both sides
            same = f.column.eqNullSafe(literal(p.value, f.kind))
            return ~same if negated else same
        return self._leaf(f, p.value, negated, lambda c, v: c == v, lambda c, v: c != v, same=True)

    def _NotEquals(self, p, negated):
        return self._Equals(P.Equals(p.field, p.value), not negated)

    def _ordered(self, p, negated, yes, no):
        if p.value is None or isinstance(p.value, (bool, list, tuple, dict)):
            return F.lit(negated)
        return self._leaf(self.field(p.field), p.value, negated, yes, no)

    def _Greater(self, p, negated):
        return self._ordered(p, negated, lambda c, v: c > v, lambda c, v: c <= v)

    def _GreaterOrEqual(self, p, negated):
        return self._ordered(p, negated, lambda c, v: c >= v, lambda c, v: c < v)

    def _Less(self, p, negated):
        return self._ordered(p, negated, lambda c, v: c < v, lambda c, v: c >= v)

    def _LessOrEqual(self, p, negated):
        return self._ordered(p, negated, lambda c, v: c <= v, lambda c, v: c > v)

    def _Between(self, p, negated):
        low = (P.GreaterOrEqual if p.with_low else P.Greater)(p.field, p.low)
        high = (P.LessOrEqual if p.with_high else P.Less)(p.field, p.high)
        return self._And(P.And((low, high)), negated)

    def _In(self, p, negated):
        f = self.field(p.field)
        plain = [v for v in dict.fromkeys(_hashable(v) for v in p.values if v is not None)]
        plain = [next(v for v in p.values if v is not None and _hashable(v) == h) for h in plain]
        nulls = any(v is None for v in p.values)
        usable = [v for v in plain if f.typed(v) is not None]
        simple = usable and all(isinstance(v, (str, int, float, date, datetime)) and not f.variant for v in usable)
        if simple:
            c = f.column
            hit = c.isin(*(literal(v, f.kind) for v in usable)) if isinstance(f.kind, (T.TimestampType, T.TimestampNTZType)) else c.isin(*usable)
            if negated:
                return c.isNotNull() & ~hit if nulls else c.isNull() | ~hit
            return hit | c.isNull() if nulls else hit
        parts = [self._Equals(P.Equals(p.field, v), negated) for v in usable] + ([self._is_null(f, negated)] if nulls else [])
        if not parts:
            return F.lit(negated)
        return reduce(lambda a, b: a & b if negated else a | b, parts)

    def _NotIn(self, p, negated):
        return self._In(P.In(p.field, p.values), not negated)

    def _Exists(self, p, negated):
        f = self.field(p.field)
        if f.variant:
            there = F.variant_get(f.variant[0], f.variant[1], "variant").isNotNull()
        elif PRESENT in self.schema.names:
            there = F.coalesce(F.array_contains(F.col(PRESENT), p.field), F.lit(False))
        elif f.column is None:
            there = F.lit(False)
        else:
            there = f.column.isNotNull()
        return ~there if negated else there

    def _IsNull(self, p, negated):
        return self._is_null(self.field(p.field), negated)

    def _IsNotNull(self, p, negated):
        return self._is_null(self.field(p.field), not negated)

    # strings

    def _string(self, name: str, negated: bool, form: Callable[[Column], Column]) -> Column:
        found = self.field(name).typed("")
        if found is None:
            return F.lit(negated)
        c = found[0]
        return c.isNull() | ~form(c) if negated else form(c)

    def _Matches(self, p, negated):
        return self._string(p.field, negated, lambda c: c.rlike(regex_flags(p.pattern, p.case, p.lines)))

    def _Contains(self, p, negated):
        f = self.field(p.field)
        if f.kind is not None and isinstance(f.kind, T.ArrayType):
            element = f.kind.elementType
            if p.value is None:
                hit = F.exists(f.column, lambda x: x.isNull())
            elif comparable(element, p.value):
                hit = F.array_contains(f.column, literal(p.value, element))
            else:
                return F.lit(negated)
            hit = F.coalesce(hit, F.lit(False))
            return ~hit if negated else hit
        if not isinstance(p.value, str):
            return F.lit(negated)
        needle = p.value if p.case else p.value.lower()
        return self._string(p.field, negated, lambda c: folded(c, p.case).contains(needle))

    def _StartsWith(self, p, negated):
        return self._string(p.field, negated, lambda c: folded(c, p.case).startswith(p.prefix if p.case else p.prefix.lower()))

    def _EndsWith(self, p, negated):
        return self._string(p.field, negated, lambda c: folded(c, p.case).endswith(p.suffix if p.case else p.suffix.lower()))

    # full text by scan

    def _parts(self, p, negated, needles, join):
        if not needles:
            return self._is_null(self.field(p.field), not negated) if self.field(p.field).typed("") else F.lit(negated)
        needles = needles if p.case else [n.lower() for n in needles]
        return self._string(p.field, negated, lambda c: reduce(join, [folded(c, p.case).contains(n) for n in needles]))

    def _TextAll(self, p, negated):
        return self._parts(p, negated, driver_tokens(p.text if p.case else p.text.lower()), lambda a, b: a & b)

    def _TextPhrase(self, p, negated):
        return self._parts(p, negated, [p.phrase], lambda a, b: a & b)

    def _TextAny(self, p, negated):
        return self._parts(p, negated, list(p.terms), lambda a, b: a | b)

    def _TextPrefix(self, p, negated):
        if not p.prefix:
            return self._parts(p, negated, [], None)
        start = p.prefix if p.case else p.prefix.lower()
        return self._string(p.field, negated, lambda c: F.exists(split_tokens(folded(c, p.case)), lambda t: t.startswith(start)))

    def _TextNear(self, p, negated):
        if len(p.terms) < 2:
            return self._parts(p, negated, list(p.terms), lambda a, b: a & b)
        terms = list(dict.fromkeys(p.terms if p.case else [t.lower() for t in p.terms]))
        return self._string(p.field, negated, lambda c: within(split_tokens(folded(c, p.case)), terms, p.distance))

    # boolean

    def _And(self, p, negated):
        return reduce(lambda a, b: a | b if negated else a & b, [self.column(x, negated) for x in p.parts])

    def _Or(self, p, negated):
        return reduce(lambda a, b: a & b if negated else a | b, [self.column(x, negated) for x in p.parts])

    def _Not(self, p, negated):
        return self.column(p.inner, not negated)


def _hashable(v: Any):
    return repr(v) if isinstance(v, (list, dict, set, bytearray)) else (type(v) is bool, v)


def within(tokens: Column, terms: list[str], distance: int) -> Column:
    """Whether all terms occur with at most ``distance`` between the first and
    the last: one pass over the hits, that keeps the latest place of every term.
    Tokens are bound as a lambda variable, so that they are computed once."""
    never = -(1 << 30)
    known = F.array(*map(F.lit, terms))

    def step(state: Column, hit: Column) -> Column:
        latest = F.transform(state["latest"], lambda v, k: F.when(k + 1 == hit["term"], hit["at"]).otherwise(v))
        return F.transform(F.array(latest), lambda x: F.struct(x.alias("latest"), (state["found"] | (hit["at"] - F.array_min(x) <= distance)).alias("found")))[0]

    def near(t: Column) -> Column:
        hits = F.filter(F.transform(t, lambda x, i: F.struct(i.alias("at"), F.array_position(known, x).cast("int").alias("term"))), lambda h: h["term"] > 0)
        start = F.struct(F.array_repeat(F.lit(never), len(terms)).alias("latest"), F.lit(False).alias("found"))
        return F.aggregate(hits, start, step)["found"]

    return F.transform(F.array(tokens), near)[0]


def compile_predicate(p: P.Predicate, target: DataFrame | T.StructType, variant: str | None = None) -> Column:
    return Compiler(target.schema if isinstance(target, DataFrame) else target, variant).column(p)
