"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what is left of them, and signs with a plain form.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"
SIGNS, SIGNS_PLAIN = "ºª ", "oa "
#: Company forms that may end a legal name.
LEGAL_FORMS = ("SOCIEDAD ANONIMA", "SRL", "SAS", "SA", "SCA", "SH", "LTDA")


def strip_accents(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), ACCENTED + SIGNS, PLAIN + SIGNS_PLAIN)


def upper_collapsed(c: Column, degree_to_o: bool = False) -> Column:
    """Without accents, in upper case, with single spaces for all white space."""
    out = F.upper(strip_accents(F.coalesce(c, F.lit(""))))
    if degree_to_o:
        out = F.translate(out, "°", "O")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_lines(c: Column) -> Column:
    """Trimmed, non-blank lines with single spaces and plain line ends."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.translate(c, " ", " "), r"\r\n?", "\n"), r"[ \t]+", " "), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def search_lines(c: Column) -> Column:
    """clean_lines, without accents and in upper case."""
    return F.upper(strip_accents(clean_lines(c)))


def search_key(c: Column) -> Column:
    """Upper-case words of A-Z and 0-9."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " "))


def path_token(c: Column, default: str = "SIN_DATO") -> Column:
    """Upper-case words joined by underscores, for a path."""
    token = F.replace(search_key(c), F.lit(" "), F.lit("_"))
    return F.when(token == "", F.lit(default)).otherwise(token)


def drop_legal_form(c: Column) -> Column:
    """search_key without a company form at its end."""
    forms = "|".join(" ".join(f) if len(f) <= 3 else f for f in LEGAL_FORMS)
    return F.trim(F.regexp_replace(search_key(c), rf"(?: (?:{'|'.join(LEGAL_FORMS)}|{forms}))+$", ""))


def slug(c: Column) -> Column:
    return F.lower(F.replace(search_key(c), F.lit(" "), F.lit("_")))


def preview(c: Column, most: int = 500) -> Column:
    """The first characters of a trimmed text, with a mark if it goes on."""
    text = F.trim(c)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("\n[...]"))).otherwise(text)
