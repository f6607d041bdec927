"""Shapes that rules share: first match, padding, additive scores, best with a margin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null."""
    return bind(F.regexp_extract(c, pattern, n), lambda found: F.when(found != "", found))


def first_match(c: Column, patterns: Sequence[str], n: int = 1) -> Column:
    return F.coalesce(*[group(c, p, n) for p in patterns])


def word(pattern: str) -> str:
    r"""\b before a pattern that begins with a letter or digit, looked at only behind that character: a
    boundary at every place of a text costs more than all else."""
    return rf"{pattern[0]}(?<=\b{pattern[0]}){pattern[1:]}"


def ahead(first: str, pattern: str) -> str:
    """A pattern that is tried only where one of its first characters stands: the same matches, and a boundary or a
    choice is not looked at in every place of a text."""
    return f"(?=[{first}])(?:{pattern})"


def zero_padded(c: Column, width: int) -> Column:
    """Zeros up to a width; longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def document_number(point: Column, number: Column) -> Column:
    return F.concat(zero_padded(point, 5), F.lit("-"), zero_padded(number, 8))


def number_by(c: Column, pattern: str) -> Column:
    """The document number whose point and number are the first two groups of a pattern."""
    return F.when(c.rlike(pattern), document_number(group(c, pattern, 1), group(c, pattern, 2)))


def points(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the points of the rules that hold."""
    return sum((F.when(F.coalesce(rule, F.lit(False)), n).otherwise(0) for rule, n in rules), F.lit(0))


def hits(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms stand in a text (not null)."""
    if len(terms) < 2:
        return sum((F.contains(c, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t)))


def pattern_hits(c: Column, patterns: Sequence[str]) -> Column:
    return sum((c.rlike(p).cast("int") for p in patterns), F.lit(0))
