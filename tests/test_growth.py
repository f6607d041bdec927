"""What larger tables made slow: facts joined anew for each step, and patterns that look for a boundary at every place."""

import re

import pytest
from pyspark.sql import functions as F

from fiscora.operators import amounts, filename, issuer
from fiscora.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["q_date_audit", "q_move_plan"])
def test_facts_are_joined_once(spark, query):
    """The plan reads a table of what it needs, not the sources of the facts once more for each side."""
    read = catalogue.queries()[query](spark, SF).inputFiles()
    assert read and not any("lineitem" in x for x in read)


def test_corrected_paths(spark):
    """Of four parts at least, a dated name, and no folder with _ above."""
    paths = {
        "root/P/2020/01/02-03FCA1_x.pdf": "root/P/2024/06/05-06FCA1_x.pdf", "P/2020/01/02-03NDB1.pdf": "P/2024/06/05-06NDB1.pdf", "/2020/01/02-03NDB1.pdf": "/2024/06/05-06NDB1.pdf", "//2020/01/02-03NDB1.pdf": "//2024/06/05-06NDB1.pdf",
        "ñandú/é/2020/01/02-03NCC1.pdf": "ñandú/é/2024/06/05-06NCC1.pdf", "2020/01/02-03FCA1.pdf": None, "02-03FCA1.pdf": None, "": None, "a/_P/2020/01/02-03FCA1.pdf": None, "_a/P/2020/01/02-03FCA1.pdf": "_a/P/2024/06/05-06FCA1.pdf", "P/2020/01/x.pdf": None,
    }
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", filename.corrected_path(F.col("path"), F.lit("05/06/2024")).alias("right")).collect()
    assert {r["path"]: r["right"] for r in rows} == paths


ODD = [
    "", " \r\n\t", "uno  dos\t tres\r\n\r\n:;-cuatro--\x0bcinco . seis. \u0085 - \nsiete\t\t:", "a\x1cb\x1dc\x1ed\x0ce f", "....  ---\n.....x.....\n  y", "\r\r\nsin fin ....", "a \x1c b   , c\n\n\n",
]


def test_lines_cleaned_as_one_text(spark):
    """A text is cleaned as its lines would be one by one; long runs of dots take one look."""
    ends = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    line = lambda x: re.sub(r"^[ \t:;,.-]+|[ \t:;,.-]+$", "", re.sub(r"[ \t]+", " ", x))
    dots = "x" + "." * 100_000 + "y"
    found = spark.createDataFrame(list(enumerate([*ODD, dots])), "k long, t string").select("k", issuer._cleaned(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in found] == [*("\n".join(x for x in map(line, ends.split(t)) if x) for t in ODD), dots]


#: The patterns as they are written plainly.
VAT = r"I\s*\.?\s*V\s*\.?\s*A\s*\.?"
RATE = lambda r: rf"\b{VAT}\s*(?:ALICUOTA\s*)?{r}\s*%|\b{r}\s*%\s*(?:DE\s*)?(?:{VAT}|IVA)\b|\bIVA\b.{{0,120}}?\b{r}\s*%"
PLAIN = {
    "vat_27": RATE(r"27(?:[.,]0+)?"), "vat_21": RATE(r"21(?:[.,]0+)?"), "vat_10_5": RATE(r"10(?:[.,]5|[.,]50)"),
    "vat_perception": r"\bPERCEP(?:CION)?\s*\.?\s*(?:DE\s*)?I\s*\.?\s*V\s*\.?\s*A\b|\bIVA\s+RG\s*3337\b|\bPERCEPCION\s+IVA\b",
    "iibb_caba_perception": r"\bPERCEP(?:CION)?\s*\.?\s*(?:DE\s*)?I\s*\.?\s*B\s*\.?\s*(?:B\s*\.?\s*)?(?:CABA|CAP\.?|CAPITAL(?:\s+FEDERAL)?)\b|\bIIBB\s+(?:CABA|CAPITAL(?:\s+FEDERAL)?)\b|\bINGRESOS\s+BRUTOS\s+(?:CABA|CAPITAL(?:\s+FEDERAL)?)\b",
    "iibb_bsas_perception": r"\bPERCEP(?:CION)?\s*\.?\s*(?:DE\s*)?I\s*\.?\s*B\s*\.?\s*B\s*\.?\s*(?:BS\.?\s*AS\.?|BUENOS\s+AIRES)\b|\bIIBB\s+(?:BS\.?\s*AS\.?|BUENOS\s+AIRES)\b|\bARBA\b",
    "internal_taxes": r"\bIMPUESTOS?\s+INTERNOS?\b|\bIMP\.?\s*INT\.?\b|\bINTERNOS?\s+[0-9]+(?:[.,][0-9]+)?\s*%",
}
TAXED = [
    "IVA 21%", "XIVA 21 %", "I.V.A. ALICUOTA 27,00 %", "121% IVA", "21% DE I V A", "27 % DE IVA", "IVA " + "x" * 119 + " 21%", "IVA " + "X" * 130 + " 21%", "IVA 121%", "10,50% IVA", "IVA 10,5", "PERCEP. DE I.V.A", "XPERCEPCION IVA", "IVA RG3337", "IVA RG 33370",
    "PERCEPCION IIBB CABA", "IIBB CAPITAL FEDERAL", "INGRESOS BRUTOS CABA", "REINGRESOS BRUTOS CABA", "PERC. IIBB", "PERCEP IB CAP.", "PERCEP IBB BS.AS.", "IIBB BUENOS AIRES", "ARBA", "BARBA", "IMP.INT.", "IMPUESTO INTERNO", "XIMPUESTOS INTERNOS", "INTERNOS 4,5 %", "INTERNO 4", "", "27.0% SIN IVA",
]


def test_taxes_by_patterns_that_begin_with_a_character(spark):
    assert not any(p.startswith(r"\b") or r"|\b" in p for p in amounts.TAXES.values())
    rows = amounts.with_taxes(spark.createDataFrame(list(enumerate(TAXED)), "k long, text string")).orderBy("k").collect()
    wrong = [(t, n) for t, r in zip(TAXED, rows, strict=True) for n in PLAIN if r[n] != bool(re.search(PLAIN[n], t.upper()))]
    assert not wrong and all(any(r[n] for r in rows) for n in PLAIN)


def test_tax_profile_names(spark):
    """The longest name, the first by doc_key on ties, as over the rows of an id taken together."""
    flags = {n: False for n in amounts.TAXES}
    rows = [dict(doc_key=k, supplier_tax_id=i, supplier_name=s, **flags | {"vat_21": k == 3}) for k, i, s in ((5, "a", "uno"), (3, "a", "dos"), (4, "a", "x"), (1, "b", "y"), (9, None, "z"))]
    found = amounts.tax_profile(spark.createDataFrame(rows))[0]
    assert {r["supplier_tax_id"]: (r["supplier_name"], r["invoices_analyzed"], r["vat_21"]) for r in found.collect()} == {"a": ("dos", 3, True), "b": ("y", 1, False)}
    assert "keys=[supplier_tax_id" in found._jdf.queryExecution().executedPlan().toString().split("HashAggregate(", 1)[1]
