"""Tokens as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and punctuation separate tokens.
SEPARATORS = r"[\s\p{P}]+"
STOP_WORDS = tuple("the a an; or and; with to on of in from for by at as; will were was is has be are; this that its it he".replace(";", "").split())


def split_tokens(c: Column) -> Column:
    return F.split(c, SEPARATORS)


def driver_tokens(text: str, least: int = 2) -> list[str]:
    """The same split in Python, for the few tokens of a query."""
    import regex

    return [t for t in regex.split(r"[\s\p{P}]+", text) if len(t) >= least]


def folded(c: Column, case: bool) -> Column:
    return c if case else F.lower(c)


@dataclass(frozen=True)
class TextConfig:
    """How an index tokenises: lengths, case, stop words."""

    least: int = 2
    most: int = 100
    case: bool = False
    stop_words: tuple[str, ...] = STOP_WORDS

    @classmethod
    def without_stop_words(cls) -> TextConfig:
        return cls(stop_words=())

    @classmethod
    def exact(cls) -> TextConfig:
        return cls(least=1, case=True, stop_words=())

    def column(self, c: Column) -> Column:
        """The kept tokens; their places in this array are their positions."""
        ok = lambda t: F.length(t).between(self.least, self.most) & (~t.isin(*self.stop_words) if self.stop_words else F.lit(True))
        return F.filter(split_tokens(folded(c.cast("string"), self.case)), ok)

    def fold(self, term: str) -> str:
        return term if self.case else term.lower()

    def tokens(self, text: str) -> list[str]:
        return [t for t in driver_tokens(self.fold(text), self.least) if len(t) <= self.most and t not in self.stop_words]


def regex_flags(pattern: str, case: bool, lines: bool) -> str:
    re.compile(pattern)  # obvious mistakes surface on the driver
    return ("" if case else "(?iu)") + ("(?m)" if lines else "") + pattern
