"""Fiscal documents written from orders, line items and suppliers, by one SQL text that Spark and
DuckDB both run. Each has decoys: a due date, an activity start, the receiver's id, and for notes the
number of the related invoice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscora.sources.tables import read

RECEIVER_ID = "30711111111"


def two(x: str) -> str:
    return f"lpad(cast({x} AS string), 2, '0')"


def tax_id(x: str) -> str:
    """SQL of eleven digits with a right check digit, from a number below 10^8."""
    d = [f"cast(substr(lpad(cast({x} AS string), 8, '0'), {i}, 1) AS int)" for i in range(1, 9)]
    total = "(15 + " + " + ".join(f"{w} * {c}" for w, c in zip((3, 2, 7, 6, 5, 4, 3, 2), d, strict=True)) + ")"
    check = f"(CASE WHEN (11 - {total} % 11) = 11 THEN 0 WHEN (11 - {total} % 11) = 10 THEN 9 ELSE 11 - {total} % 11 END)"
    return f"concat('30', lpad(cast({x} AS string), 8, '0'), cast({check} AS string))"


def dashed(x: str) -> str:
    return f"concat(substr({x}, 1, 2), '-', substr({x}, 3, 8), '-', substr({x}, 11, 1))"


def cents_text(x: str) -> str:
    """SQL of hundredths as 1234.50."""
    return f"concat(cast(cast(floor({x} / 100) AS bigint) AS string), '.', lpad(cast({x} % 100 AS string), 2, '0'))"


def day(d: str, sep: str = "/") -> str:
    return f"concat({two(f'extract(day FROM {d})')}, '{sep}', {two(f'extract(month FROM {d})')}, '{sep}', cast(extract(year FROM {d}) AS string))"


#: What is true of each document. doc_key % 3: type; (doc_key / 3) % 3: letter; % 4: layout.
FACTS = f"""
SELECT doc_key, s_suppkey, s_name, issued, cents, cast({cents_text('cents')} AS decimal(18,2)) AS total, kind, letter, layout, point, number_, tax_digits,
       concat(lpad(cast(point AS string), 5, '0'), '-', lpad(cast(number_ AS string), 8, '0')) AS document_number,
       concat(CASE kind WHEN 'FACTURA' THEN 'FC' WHEN 'NOTA DE CREDITO' THEN 'NC' ELSE 'ND' END, letter) AS fiscal_code,
       {day('issued')} AS issue_date, {dashed('tax_digits')} AS supplier_tax_id,
       concat('PROVEEDOR ', upper(replace(s_name, '#', ' ')), ' SA') AS legal_name
FROM (SELECT o_orderkey AS doc_key, s_suppkey, s_name, cast(o_orderdate AS date) AS issued, cast(round(o_totalprice * 100) AS bigint) AS cents,
             CASE o_orderkey % 3 WHEN 0 THEN 'FACTURA' WHEN 1 THEN 'NOTA DE CREDITO' ELSE 'NOTA DE DEBITO' END AS kind,
             CASE cast(floor(o_orderkey / 3) AS bigint) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS letter,
             o_orderkey % 4 AS layout, cast(o_orderkey % 97 + 1 AS int) AS point, o_orderkey AS number_, {tax_id('s_suppkey')} AS tax_digits
      FROM {{orders}} JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM {{lineitem}} GROUP BY l_orderkey) AS l ON o_orderkey = l_orderkey
      JOIN {{supplier}} ON suppkey = s_suppkey) AS d
"""

_NL = "chr(10)"
_FLAT_TOTAL = cents_text("cents")
#: 1234.50 as it stands, 1.234,50 by point and comma, or 1,234.50 by comma and point.
_WHOLE = "cast(cast(floor(cents / 100) AS bigint) AS string)"
_GROUPED = f"CASE WHEN length({_WHOLE}) > 6 THEN concat(substr({_WHOLE}, 1, length({_WHOLE}) - 6), '@', substr({_WHOLE}, length({_WHOLE}) - 5, 3), '@', substr({_WHOLE}, length({_WHOLE}) - 2, 3)) WHEN length({_WHOLE}) > 3 THEN concat(substr({_WHOLE}, 1, length({_WHOLE}) - 3), '@', substr({_WHOLE}, length({_WHOLE}) - 2, 3)) ELSE {_WHOLE} END"
_CENTS = "lpad(cast(cents % 100 AS string), 2, '0')"
AMOUNT = f"CASE doc_key % 3 WHEN 0 THEN {_FLAT_TOTAL} WHEN 1 THEN concat(replace({_GROUPED}, '@', '.'), ',', {_CENTS}) ELSE concat(replace({_GROUPED}, '@', ','), '.', {_CENTS}) END"
_TITLE = "CASE kind WHEN 'NOTA DE CREDITO' THEN 'NOTA DE CRÉDITO' WHEN 'NOTA DE DEBITO' THEN 'NOTA DE DÉBITO' ELSE kind END"
_CODE = "CASE concat(substr(fiscal_code, 1, 2), letter) WHEN 'FCA' THEN '001' WHEN 'NDA' THEN '002' WHEN 'NCA' THEN '003' WHEN 'FCB' THEN '006' WHEN 'NDB' THEN '007' WHEN 'NCB' THEN '008' WHEN 'FCC' THEN '011' WHEN 'NDC' THEN '012' ELSE '013' END"
_RELATED = f"CASE WHEN kind = 'FACTURA' THEN '' ELSE concat('Comprobante asociado: 00099-99', lpad(cast(number_ % 1000000 AS string), 6, '0'), {_NL}) END"
_HEAD = f"""CASE layout
  WHEN 0 THEN concat({_TITLE}, ' ', letter, {_NL}, 'Nro. ', document_number, {_NL}, 'Fecha de Emisión: ', issue_date, {_NL})
  WHEN 1 THEN concat(letter, '  COD. ', {_CODE}, ' ', {_TITLE}, {_NL}, 'Número: ', cast(point AS string), ' - ', lpad(cast(number_ AS string), 8, '0'), {_NL}, 'FECHA: ', {day('issued', '-')}, {_NL})
  WHEN 2 THEN concat({_TITLE}, {_NL}, 'Código ', {_CODE}, {_NL}, 'Nro. ', document_number, {_NL}, 'Fecha del comprobante ', {day('issued', '.')}, {_NL})
  ELSE concat(legal_name, {_NL}, {_TITLE}, ' - ', letter, {_NL}, 'Nro: ', document_number, {_NL}, 'Fecha Emisión ', issue_date, {_NL}) END"""
VAT_21, VAT_10 = "cast(floor(cents * 21 / 100) AS bigint)", "cast(floor(cents / 10) AS bigint)"
TEXT = f"""concat({_HEAD}, 'Inicio de actividades: 01/03/1999', {_NL}, 'Razón social: ', legal_name, {_NL}, 'CUIT: ', supplier_tax_id, {_NL},
  'Cliente: RECEPTORA DE PRUEBA SRL CUIT 30-71111111-1', {_NL}, {_RELATED},
  CASE WHEN doc_key % 5 = 0 THEN concat('Moneda: Dólares estadounidenses USD', {_NL}) ELSE '' END,
  CASE WHEN doc_key % 2 = 0 THEN concat('IVA 21% ', {cents_text(VAT_21)}, {_NL}) ELSE concat('IVA 10,5%: ', {cents_text(VAT_10)}, {_NL}) END,
  CASE WHEN doc_key % 7 = 0 THEN concat('Percepción IIBB CABA 3%', {_NL}) ELSE '' END,
  CASE WHEN doc_key % 11 = 0 THEN concat('Impuestos internos 4,5%', {_NL}) ELSE '' END,
  'Subtotal: $ ', {AMOUNT}, {_NL}, 'Importe total: $ ', {AMOUNT}, {_NL},
  'CAE N°: 7', lpad(cast(doc_key AS string), 13, '0'), {_NL}, 'Fecha de vto. de CAE: ', {day('issued')}, {_NL})"""
WRITTEN = f"SELECT f.*, {TEXT} AS text, concat(tax_digits, '_', {_CODE}, '_', lpad(cast(point AS string), 5, '0'), '_', lpad(cast(number_ AS string), 8, '0'), '.pdf') AS name FROM __facts__ AS f"
INVOICES = WRITTEN.replace("__facts__", f"({FACTS})")
TABLES = {"orders": "orders", "lineitem": "lineitem", "supplier": "supplier"}


def facts_sql() -> str:
    return FACTS.format(**TABLES)


def invoices_sql() -> str:
    return INVOICES.format(**TABLES)


def _query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in TABLES})


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WRITTEN.replace("__facts__", "{facts}"), facts=_dealt(spark, sf_dir))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts on all cores before the text work: the source tables are one file each. Not by a key: the
    join above has dealt by it already, so that shuffle would be dropped and the rest coalesced."""
    return facts(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, FACTS)


#: Families of layouts that tell an issuer, or should not: what stands on the page, a hint, and the name
#: and score that are due. PAGE_LINES count three points.
PAGE_LINES = f"'PUNTO DE VENTA 0001', {_NL}, 'Inicio de actividades 01/01/2000', {_NL}"
_MARK = "translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ')"
_HOUSE, _TOWER, _ID, _OTHER_ID = "house", "tower", "supplier_tax_id", "other_tax_id"
_FILL = f"'Domicilio', {_NL}, 'Cantidad', {_NL}, 'Descripción', {_NL}"
ISSUERS = (
    # After a mark of copies.
    (f"'ORIGINAL', {_NL}, {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 32),
    # Below a label, the id below its own.
    (f"'FACTURA A', {_NL}, 'Razón Social', {_NL}, {_HOUSE}, {_NL}, 'Domicilio', {_NL}, 'CUIT', {_NL}, {_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 27),
    # A consortium in pieces.
    (f"'CONSORCIO', {_NL}, 'COPROPIETARIOS', {_NL}, 'Edificio ', {_TOWER}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", f"concat('CONSORCIO COPROPIETARIOS EDIFICIO ', {_TOWER})", 31),
    # A consortium in one line, with the fraction of its address.
    (f"'Beneficiario: Consorcio de ', {_TOWER}, ' 703/787', {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", f"concat('CONSORCIO DE ', {_TOWER})", 35),
    # An explicit name one point ahead of a composed one.
    (f"'CONSORCIO', {_NL}, 'COPROPIETARIOS', {_NL}, {_TOWER}, {_NL}, {_FILL}, 'Razón social: ', {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 30),
    # Two explicit names.
    (f"'Razón social: ', {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, 'Razón social: OTRA CASA ', {_TOWER}, ' SRL', {_NL}, {PAGE_LINES}", None, None),
    # Two third-party ids.
    (f"'ORIGINAL', {_NL}, {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, 'CUIT transporte: ', {_OTHER_ID}, {_NL}, {PAGE_LINES}", None, None),
    # The id by a hint only.
    (f"'ORIGINAL', {_NL}, {_HOUSE}, {_NL}, 'Domicilio', {_NL}, {PAGE_LINES}", _HOUSE, 23),
    # A valid id beside the receiver's name is the receiver's.
    (f"'ORIGINAL', {_NL}, {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, 'Cliente RECEPTORA DE PRUEBA SRL', {_NL}, 'CUIT: ', {_OTHER_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 32),
    # The issuer's id by its label, nothing else on the page.
    (f"{_HOUSE}, {_NL}, 'CUIT EMISOR: ', {_ID}, {_NL}, 'Motivo devolución de envases', {_NL}", _HOUSE, 31),
    # The kind of the document glued to the name.
    (f"'Nota de Crédito ', {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 28),
    # Far from the id, and nothing else.
    (f"{_HOUSE}, {_NL}, repeat(concat('Subtotal', {_NL}), 22), 'X ', {_ID}, {_NL}", None, None),
    # An address is no name.
    (f"'Calle Falsa Piso ', {_TOWER}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", None, None),
    # A trade name gives way to the legal one.
    (f"'Nombre de fantasía: Bar ', {_TOWER}, {_NL}, 'Razón social: ', {_HOUSE}, {_NL}, 'CUIT: ', {_ID}, {_NL}, {PAGE_LINES}", _HOUSE, 30),
    # The receiver's id alone.
    (f"'ORIGINAL', {_NL}, {_HOUSE}, {_NL}, 'CUIT 30-71111111-1', {_NL}, {PAGE_LINES}", None, None),
)
HINTED = 7


def _by_family(values: list) -> str:
    return f"CASE doc_key % {len(ISSUERS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"


ISSUER_PAGES = f"""SELECT *, {_by_family([f'concat({text})' for text, _, _ in ISSUERS])} AS text, CASE WHEN doc_key % {len(ISSUERS)} = {HINTED} THEN {_ID} END AS hint,
  {_by_family([name for _, name, _ in ISSUERS])} AS issuer, {_by_family([score for _, _, score in ISSUERS])} AS score
FROM (SELECT doc_key, supplier_tax_id, {dashed(tax_id('(s_suppkey + 1)'))} AS other_tax_id, concat('ALMACEN K', {_MARK}, ' SRL') AS house, concat('TORRE K', {_MARK}) AS tower FROM __facts__) AS f"""


def issuer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ISSUER_PAGES.replace("__facts__", "{facts}"), facts=_dealt(spark, sf_dir))


def issuer_pages_sql() -> str:
    return ISSUER_PAGES.replace("__facts__", f"({facts_sql()}) AS x")
