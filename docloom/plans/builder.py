"""A fluent, immutable builder of predicates.

Every method ANDs a condition to what is there, from the left: ``a.b.c`` is
``(a and b) and c``, hence ``a.or_(b).c`` is ``(a or b) and c``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from . import predicates as P


@dataclass(frozen=True)
class Where:
    current: P.Predicate | None = None

    def and_(self, p: P.Predicate) -> Where:
        return Where(p if self.current is None else P.And((self.current, p)))

    def or_(self, p: P.Predicate) -> Where:
        return Where(p if self.current is None else P.Or((self.current, p)))

    def or_all(self, parts: Sequence[P.Predicate]) -> Where:
        """One flat OR with all of ``parts``; nothing for none."""
        if not parts:
            return self
        every = (*([self.current] if self.current is not None else []), *parts)
        return Where(P.Or(every) if len(every) > 1 else every[0])

    def not_(self, p: P.Predicate) -> Where:
        return self.and_(P.Not(p))

    def equals(self, field: str, value: Any) -> Where:
        return self.and_(P.Equals(field, value))

    def not_equals(self, field: str, value: Any) -> Where:
        return self.and_(P.NotEquals(field, value))

    def greater(self, field: str, value: Any) -> Where:
        return self.and_(P.Greater(field, value))

    def at_least(self, field: str, value: Any) -> Where:
        return self.and_(P.GreaterOrEqual(field, value))

    def less(self, field: str, value: Any) -> Where:
        return self.and_(P.Less(field, value))

    def at_most(self, field: str, value: Any) -> Where:
        return self.and_(P.LessOrEqual(field, value))

    def between(self, field: str, low: Any, high: Any, with_low: bool = True, with_high: bool = True) -> Where:
        return self.and_(P.Between(field, low, high, with_low, with_high))

    def in_(self, field: str, values: Sequence[Any]) -> Where:
        return self.and_(P.In(field, tuple(values)))

    def not_in(self, field: str, values: Sequence[Any]) -> Where:
        return self.and_(P.NotIn(field, tuple(values)))

    def matches(self, field: str, pattern: str, case: bool = True, lines: bool = False) -> Where:
        return self.and_(P.Matches(field, pattern, case, lines))

    def exists(self, field: str) -> Where:
        return self.and_(P.Exists(field))

    def is_null(self, field: str) -> Where:
        return self.and_(P.IsNull(field))

    def is_not_null(self, field: str) -> Where:
        return self.and_(P.IsNotNull(field))

    def contains(self, field: str, value: Any, case: bool = True) -> Where:
        return self.and_(P.Contains(field, value, case))

    def starts_with(self, field: str, prefix: str, case: bool = True) -> Where:
        return self.and_(P.StartsWith(field, prefix, case))

    def ends_with(self, field: str, suffix: str, case: bool = True) -> Where:
        return self.and_(P.EndsWith(field, suffix, case))

    def text(self, field: str, text: str, case: bool = False) -> Where:
        return self.and_(P.TextAll(field, text, case))

    def phrase(self, field: str, phrase: str, case: bool = False) -> Where:
        return self.and_(P.TextPhrase(field, phrase, case))

    def any_term(self, field: str, terms: Sequence[str], case: bool = False) -> Where:
        return self.and_(P.TextAny(field, tuple(terms), case))

    def term_prefix(self, field: str, prefix: str, case: bool = False) -> Where:
        return self.and_(P.TextPrefix(field, prefix, case))

    def near(self, field: str, terms: Sequence[str], distance: int, case: bool = False) -> Where:
        return self.and_(P.TextNear(field, tuple(terms), distance, case))

    @property
    def has_conditions(self) -> bool:
        return self.current is not None

    def reset(self) -> Where:
        return Where()

    def build(self) -> P.Predicate:
        if self.current is None:
            raise ValueError("no condition was given")
        return self.current

    def build_or_all(self) -> P.Predicate:
        return self.current if self.current is not None else P.All()

    def to_dict(self) -> dict:
        return self.build().to_dict()
