"""The parsed document as a record: whether parsing went through and what it says, errors of
values that are there (2.C C3), and parts of its number (2.I N18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.functions.dates import from_parts
from fiscora.operators import amounts, header

FIELDS = ("document_type", "fiscal_letter", "document_number", "issue_date", "issuer_tax_id", "receiver_tax_id", "currency", "subtotal", "taxes", "total_amount", "cae", "cae_expiration")
LETTERS = ("A", "B", "C")
#: What a parsed text is told to be.
NO_TEXT, BLANK, NOTHING = "El valor recibido no es una cadena de caracteres.", "No se recibió texto válido para analizar.", "El texto pudo analizarse, pero todavía no se detectaron datos reconocibles."


def is_date(c: Column) -> Column:
    """Whether a text is a day as day/month/year, day-month-year or year-month-day."""
    at = lambda shape, *i: from_parts(*[F.regexp_extract(c, shape, k).try_cast("int") for k in i])
    shapes = ((r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1), (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3))
    out = F.when(F.lit(False), False)
    for shape, *i in shapes:
        out = out.when(c.rlike(shape), at(shape, *i).isNotNull())
    return out.otherwise(False)


def value_errors(letter: Column, date: Column) -> Column:
    """Array of what is wrong with a letter or date that is there; a missing or empty one is no error."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    wrong_letter = F.when(said(letter) & ~F.upper(letter).isin(*LETTERS), F.concat(F.lit("Letra fiscal no admitida: '"), letter, F.lit("'")))
    wrong_date = F.when(said(date) & ~is_date(date), F.concat(F.lit("Fecha de emisión inválida: '"), date, F.lit("'")))
    return F.array_compact(F.array(wrong_letter, wrong_date))


def point_of_sale(number: Column) -> Column:
    """What stands before the first hyphen, null without one."""
    return F.when(F.contains(number, F.lit("-")), F.substring_index(number, "-", 1))


def sequential_number(number: Column) -> Column:
    """What stands behind the first hyphen, null without one."""
    return F.when(F.contains(number, F.lit("-")), F.substring(number, F.instr(number, "-") + 1, F.length(number)))


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Docs with the header, amounts, `successful` and `message`: a null text is none, a blank one has
    nothing to be parsed, and any other one tells how many of FIELDS were found."""
    found = amounts.with_amounts(header.with_header(docs, text), text)
    n = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    blank = F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) == ""
    told = F.when(n == 0, NOTHING).otherwise(F.concat(F.lit("Análisis completado. Se detectaron "), n.cast("string"), F.lit(" datos.")))
    message = F.when(F.col(text).isNull(), NO_TEXT).when(blank, BLANK).otherwise(told)
    return found.withColumns({"successful": F.coalesce(~blank, F.lit(False)), "message": message, "point_of_sale": point_of_sale(F.col("document_number")), "sequential_number": sequential_number(F.col("document_number"))})
