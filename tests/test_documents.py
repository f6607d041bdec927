"""Headers, names, classes, issuers and suppliers of made-up layouts."""

import pytest
from pyspark.sql import functions as F

from fiscora.operators import amounts, classify, filename, fusion, header, issuer, suppliers


def one(spark, text, name="x.pdf"):
    return spark.createDataFrame([(1, text, name)], "doc_key long, text string, name string")


HEADERS = [
    ("FACTURA A\nNº 0001-00000002\nFecha de Emisión: 03/04/2024", ("FACTURA", "A", "00001-00000002", "03/04/2024")),
    ("Nota de Crédito B\nNro 1-15\nFecha 01/02/2024", ("NOTA DE CREDITO", "B", "00001-00000015", "01/02/2024")),
    ("FA C T U R A\nCOD. 011\nNro. 3-4 Fecha: 05/06/2024", ("FACTURA", "C", "00003-00000004", "05/06/2024")),
    ("NOTA DE DEBITO A Nro: 0002-00000009\nComprobante asociado: Factura A 0001-00000001\nFecha de emision 07/08/2024", ("NOTA DE DEBITO", "A", "00002-00000009", "07/08/2024")),
    ("TOTAL DEBITO 100 Nro 1-22 CUIT 30-71111111-1", ("NOTA DE DEBITO", None, "00001-00000022", None)),
    ("REMITO - NO ES FACTURA Nro 1-22", (None, None, "00001-00000022", None)),
    ("Inicio de actividades: 01/01/1990 FACTURA B Nro 5-6 Fecha: 09/10/2024 Vencimiento: 19/10/2024", ("FACTURA", "B", "00005-00000006", "09/10/2024")),
    ("FACTURA A 0001-00000002 FECHA EMISION 03/04/2014 VTO: 10/04/2024", ("FACTURA", "A", "00001-00000002", "03/04/2024")),
    ("B 00021-00001477 08 07 25 FACTURA F.VTO: 18/07/2025", ("FACTURA", "B", "00021-00001477", "08/07/2025")),
    ("FACTURA A del 12 DE MAYO DE 2026", ("FACTURA", "A", None, "12/05/2026")),
    ("Lista de precios", (None, None, None, None)),
    ("", (None, None, None, None)),
    (None, (None, None, None, None)),
]


def test_headers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)], "doc_key long, text string")
    found = header.with_header(rows).orderBy("doc_key").select("document_type", "fiscal_letter", "document_number", "issue_date").collect()
    for (text, wanted), row in zip(HEADERS, found, strict=True):
        assert tuple(row) == wanted, text


NAMES = [
    ("FC A 0003-00025066 x.pdf", ("FACTURA", "A", "00003-00025066")), ("FCA000600343487.pdf", ("FACTURA", "A", "00006-00343487")),
    ("30711111111_999_00004_00000375.pdf", (None, None, "00004-00000375")), ("Factura 0004-00219487.pdf", (None, None, "00004-00219487")),
    ("Nota de Débito N° C-00006-00001390.pdf", ("NOTA DE DEBITO", "C", "00006-00001390")), ("apuntes.pdf", (None, None, None)), (None, (None, None, None)),
]


def test_names(spark):
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, name string")
    found = rows.select("i", filename.evidence(F.col("name")).alias("e")).orderBy("i").select("e.document_type", "e.fiscal_letter", "e.document_number").collect()
    assert [tuple(r) for r in found] == [w for _, w in NAMES]


@pytest.mark.parametrize(
    "text, name, wanted",
    [
        ("Factura A 0001-00000002 CUIT 30-71111111-1 CAE 12345678901234 IVA 21% Total 1", "a.pdf", "factura"),
        ("nada", "LISTA DE PRECIOS marzo.pdf", "lista_precios"), ("Orden de pago 3", "a.pdf", "orden_pago"),
        ("Este documento NO ES COMPROBANTE DE PAGO", "a.pdf", "desconocido"), ("Recibo oficial de Factura A 0001-00000002", "a.pdf", "remito_recibo"), ("", "", "desconocido"),
    ],
)
def test_classes(spark, text, name, wanted):
    assert classify.with_category(one(spark, text, name)).first()["category"] == wanted


def test_taxes(spark):
    row = amounts.with_taxes(one(spark, "IVA 10,5% 12,00\nPercepción IIBB CABA 3\nImp. Int. 2")).first()
    assert (row["vat_10_5"], row["vat_21"], row["iibb_caba_perception"], row["internal_taxes"]) == (True, False, True, True)


def test_issuer(spark):
    layout = "ORIGINAL\nALMACEN DEL PUERTO SRL\nCUIT: 30-00000003-1\nPunto de venta 0001\nInicio de actividades: 01/01/2000\nRECEPTORA DE PRUEBA CUIT 30-71111111-1"
    found = issuer.issuer_identity(one(spark, layout), "30711111111", "RECEPTORA DE PRUEBA").collect()
    assert [(r["tax_id"], r["name"]) for r in found] == [("30-00000003-1", "ALMACEN DEL PUERTO SRL")]
    two = layout + "\nOtra linea 1\nCUIT 30-00000000-7"
    assert not issuer.issuer_identity(one(spark, two), "30711111111", "RECEPTORA DE PRUEBA").count()
    assert not issuer.issuer_identity(one(spark, ""), "30711111111", "RECEPTORA DE PRUEBA").count()


CATALOGUE = [("uno", "Primera Casa SA", "Solo", "30-00000003-1", None), ("dos", "Segunda Casa SRL", "ZZ", "30-00000000-7", None)]


@pytest.mark.parametrize(
    "text, identifier, method",
    [
        ("Primera Casa SA 30-00000003-1", "uno", "razon_social_y_cuit"), ("cuit 30000000031", "uno", "cuit"), ("PRIMERA CASA S.A.", "uno", "razon_social"),
        ("PRIMERA CASA cuit 30-00000000-7", None, "evidencia_contradictoria"), ("ZZ", None, "coincidencia_textual_debil"), ("Primera Casa y Segunda Casa", None, "candidatos_empatados"),
        ("XZZX", None, "sin_coincidencias"), (" ", None, "texto_vacio"), (None, None, "texto_ausente"),
    ],
)
def test_suppliers(spark, text, identifier, method):
    catalogue = suppliers.with_aliases(spark.createDataFrame(CATALOGUE, "identifier string, legal_name string, display_name string, cuit string, aliases array<string>"))
    docs = one(spark, text)
    row = suppliers.resolve(docs, suppliers.candidates(docs, catalogue, "30711111111")).first()
    assert (row["identifier"], row["method"]) == (identifier, method)


def test_readings(spark):
    rows = [(1, "a", "x", 5, "FACTURA", None), (1, "b", "xx", 9, None, "A"), (1, "c", "xxx", 9, None, "B")]
    passes = spark.createDataFrame(rows, "doc_key long, method string, text string, score long, document_type string, fiscal_letter string")
    assert fusion.best_reading(passes).first()["method"] == "c"
    row = fusion.fused_fields(passes, ("document_type", "fiscal_letter")).first()
    assert (row["document_type"], row["fiscal_letter"]) == ("FACTURA", "B")


def test_rules_of_one_house(spark):
    rules = (classify.Rule("impuestos_servicios", "name", 12, ("1234567 PDF",), once=True),)
    docs = one(spark, "nada", "1234567 pdf")
    assert classify.with_category(docs).first()["category"] == "desconocido"
    assert classify.with_category(docs, house=rules).first()["category"] == "impuestos_servicios"
