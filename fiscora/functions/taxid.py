"""Tax ids of eleven digits with a modulus-11 check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: No digit before it, which is looked at only where a digit is.
SHAPE = r"(\d(?<!\d\d)\d\s*[-.]?\s*\d{8}\s*[-.]?\s*\d)(?!\d)"


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def valid(c: Column) -> Column:
    """Whether eleven digits end in the right check digit; 10 counts as 9, 11 as 0."""
    return _checked(digits(c))


def _checked(d: Column) -> Column:
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    rest = 11 - F.pmod(total, F.lit(11))
    check = F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest)
    return F.when(F.length(d) == 11, check == F.substring(d, 11, 1).cast("int")).otherwise(False)


def formatted(c: Column) -> Column:
    """NN-NNNNNNNN-N of any eleven digits, else null."""
    return _dashed(digits(c))


def _dashed(d: Column) -> Column:
    return F.when(F.length(d) == 11, F.concat(F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 8), F.lit("-"), F.substring(d, 11, 1)))


def formatted_valid(c: Column) -> Column:
    return F.when(valid(c), formatted(c))


def valid_in(text: Column) -> Column:
    """Distinct valid ids of a text, in order."""
    # The digits alone are bound first: both functions name them many times.
    found = F.transform(F.transform(F.regexp_extract_all(text, F.lit(SHAPE), F.lit(1)), digits), lambda d: F.when(_checked(d), _dashed(d)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def all_in(text: Column) -> Column:
    """Distinct ids of a text in order, whatever their check digit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SHAPE), F.lit(1)), formatted))
