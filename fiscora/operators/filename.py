"""What a file name says of its document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscora.functions.cascade import document_number, group, zero_padded
from fiscora.functions.dates import from_parts
from fiscora.functions.text import path_token, strip_accents
from fiscora.operators.header import CODES, CREDIT, DEBIT, INVOICE

#: Fixed values, in the order in which they are tried: method, pattern, type, letter, point and
#: number; a type or letter is a group's number, a value, or None.
METHODS = (
    ("nombre_con_tipo_letra_y_numero", r"\b(FC|NC|ND)\s*[-_ ]*([ABC])\s*[-_ ]*(\d{1,5})\s*[-_]\s*(\d{1,8})\b", 1, 2, 3),
    ("nombre_con_tipo_letra_y_numero", r"\b(FC|NC|ND)([ABC])(\d{4,5})(\d{8})\b", 1, 2, 3),
    ("nombre_con_tipo_letra_y_numero", r"\b(FA)\s*[-_ ]*([ABC])\s*[-_ ]*(\d{1,5})\s*[-_]\s*(\d{1,8})\b", 1, 2, 3),
    ("nombre_fac_compacto", r"FAC([ABC])(\d{4,5})(\d{8})(?:_ORIG)?$", INVOICE, 1, 2),
    ("nombre_factura_descriptiva", r"\bFACTURA(?:[_ ]+DE[_ ]+VENTA)?(?:[_ ]+ARCA)?[_ ]*(?:NRO|N)?[_ °º]*([ABC])[_ -]*(\d{1,5})[-_](\d{1,8})\b", INVOICE, 1, 2),
    ("nombre_fcvta", r"\b(?:COMPROBANTE[-_ ]*)?FCVTA[-_ ]*([ABC])[-_ ]*(\d{1,5})[-_ ]*(\d{1,8})\b", INVOICE, 1, 2),
    ("nombre_nota_descriptiva", r"\bNOTA[_ ]+(?:DE[_ ]+)?(CREDITO|DEBITO)(?:[_ ]+NRO|[_ ]+N)?[_ °º]*([ABC])[-_ ]*(\d{1,5})[-_](\d{1,8})\b", 1, 2, 3),
    ("nombre_nd_compacto", r"\bN[_ -]*D([ABC])(\d{4,5})(\d{8})\b", DEBIT, 1, 2),
    ("nombre_factura_sistema_gestion", r"\b(?:VENTA[_ -]*A|M[_ -]*FACTA)(\d{1,5})[-_](\d{1,8})\b", INVOICE, "A", 1),
    ("nombre_nc_compacto_flexible", r"\bN[_ -]*C[_ -]*([ABC])(\d{4,5})(\d{8})\b", CREDIT, 1, 2),
    ("nombre_fact_sap_compacto", r"FACT[_ -]*([ABC])(\d{4,5})(\d{8})\b", INVOICE, 1, 2),
    ("nombre_cuit_letra_numero", r"\b\d{11}[_ -]+([ABC])[-_](\d{1,5})[-_](\d{1,8})\b", None, 1, 2),
    ("nombre_con_codigo_afip", r"\b\d{11}[_-](\d{2,3})[_-](\d{1,5})[_-](\d{1,8})\b", "code", "code", 2),
    ("nombre_con_numero", r"\bFACTURA\s*(\d{1,5})\s*[-_]\s*(\d{1,8})\b", None, None, 1),
)
#: Methods whose findings replace those of the content; others fill gaps.
OVERRIDING = ("nombre_con_tipo_letra_y_numero", "nombre_fac_compacto", "nombre_factura_descriptiva", "nombre_fcvta", "nombre_nota_descriptiva", "nombre_nd_compacto", "nombre_fact_sap_compacto", "nombre_con_codigo_afip")
_KINDS = {"FC": INVOICE, "FA": INVOICE, "NC": CREDIT, "ND": DEBIT, "CREDITO": CREDIT, "DEBITO": DEBIT}


def _lookup(c: Column, table: dict) -> Column:
    out = F.when(F.lit(False), "")
    for key, value in table.items():
        out = out.when(c == key, value)
    return out


def stem(name: Column) -> Column:
    return F.upper(strip_accents(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")))


def evidence(name: Column) -> Column:
    """A struct of document_type, fiscal_letter, document_number and method: of the first pattern
    that fits, or nulls."""
    s = stem(name)
    null = F.lit(None).cast("string")
    out = None
    for method, pattern, kind, letter, at in METHODS:
        code = group(s, pattern, 1).cast("int")
        kind_col = _lookup(code, {k: v[0] for k, v in CODES.items()}) if kind == "code" else _lookup(group(s, pattern, kind), _KINDS) if isinstance(kind, int) else F.lit(kind).cast("string")
        letter_col = _lookup(code, {k: v[1] for k, v in CODES.items()}) if letter == "code" else group(s, pattern, letter) if isinstance(letter, int) else F.lit(letter).cast("string")
        found = F.struct(kind_col.alias("document_type"), letter_col.alias("fiscal_letter"), document_number(group(s, pattern, at), group(s, pattern, at + 1)).alias("document_number"), F.lit(method).alias("method"))
        out = F.when(s.rlike(pattern), found) if out is None else out.when(s.rlike(pattern), found)
    return out.otherwise(F.struct(null.alias("document_type"), null.alias("fiscal_letter"), null.alias("document_number"), null.alias("method")))


def fused(field: str, content: Column, name: Column) -> Column:
    """a structured name overrides the content, another one fills its gaps."""
    said = name[field]
    return F.when(name["method"].isin(*OVERRIDING), F.coalesce(said, content)).otherwise(F.coalesce(content, said))


def fiscal_key(name: Column) -> Column:
    """FCA:00006:00343487 of an organised file's name."""
    shape = r"(?i)(FC|NC|ND)([ABC])(\d{4,5})-(\d{6,10})(?=_|\.pdf)"
    return F.when(name.rlike(shape), F.concat_ws(":", F.upper(F.concat(F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 2))), zero_padded(F.regexp_extract(name, shape, 3), 5), zero_padded(F.regexp_extract(name, shape, 4), 8)))


def canonical_name(date_text: Column, code: Column, num: Column, receiver: Column, supplier: Column) -> Column:
    """B2: DD-MMFCA00006-00343487_RECEIVER_SUPPLIER.pdf, or null if the code is unsupported."""
    day = F.regexp_replace(date_text, r"^(\d\d)/(\d\d)/\d{4}$", "$1-$2")
    return F.concat(day, code, num, F.lit("_"), path_token(receiver), F.lit("_"), path_token(supplier), F.lit(".pdf"))


def folder(supplier: Column, date_text: Column, root: str = "") -> Column:
    """B1: SUPPLIER/YYYY/MM."""
    parts = [path_token(supplier, "PROVEEDOR_SIN_IDENTIFICAR"), F.substring(date_text, 7, 4), F.substring(date_text, 4, 2)]
    return F.concat_ws("/", *([F.lit(root)] if root else []), *parts)


def corrected_path(path: Column, date_text: Column) -> Column:
    """An organised path with the day and month of its name, and its year and month folders,
    put right; null for paths of another shape or below a folder that begins with _."""
    tail = F.substring_index(path, "/", -3)
    name = F.substring_index(path, "/", -1)
    # Of paths with fewer than four parts the tail is all, and there is no head.
    head = F.when(F.length(tail) < F.length(path), F.substring(path, F.lit(1), F.length(path) - F.length(tail) - 1))
    right = F.concat(F.substring(date_text, 1, 2), F.lit("-"), F.substring(date_text, 4, 2), F.substring(name, 6, 1000))
    ok = date_text.isNotNull() & head.isNotNull() & name.rlike(r"^\d\d-\d\d(?:FC|NC|ND)[ABC]") & ~F.startswith(F.substring_index(head, "/", -1), F.lit("_"))
    return F.when(ok, F.concat_ws("/", head, F.substring(date_text, 7, 4), F.substring(date_text, 4, 2), right))


def valid_day(date_text: Column) -> Column:
    return from_parts(F.substring(date_text, 7, 4).try_cast("int"), F.substring(date_text, 4, 2).try_cast("int"), F.substring(date_text, 1, 2).try_cast("int"))
