"""Text helpers with the meaning Python gives them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """``str.strip()``: all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """``str.split()``: an array of words without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def count_of(c: Column, literal: str) -> Column:
    """``str.count()`` of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def between(c: Column, start: str, end: str) -> Column:
    """``c.split(start)[-1].split(end)[0]``."""
    last = F.element_at(F.split(c, _quote(start)), -1)
    return F.element_at(F.split(last, _quote(end)), 1)


def _quote(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null (not empty) where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tag(c: Column, name: str, dotall: bool = True) -> Column:
    """The text inside the first ``<name>`` element, null where there is none."""
    return found(c, ("(?s)" if dotall else "(?d)") + f"<{name}>(.*?)</{name}>")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` over ``value``, which is worked out once however often it is used, also within lambdas."""
    return F.transform(F.array(value), build)[0]


def ngrams(c: Column, n: int) -> Column:
    """Arrays of ``n`` consecutive lower-cased words, joined by spaces; empty for short texts."""

    def grams(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    return bound(words(F.lower(c)), grams)
