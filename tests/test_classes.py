"""Classification: patterns that begin with a character find what the plain ones do, and terms are arrays."""

import random
import re

from pyspark.sql import functions as F

from fiscora.functions.cascade import hits
from fiscora.operators import classify
from fiscora.operators.header import PAIR, SHARED, SHARED_NUMBER, SHARED_VAT

ID = r"(?<!\d)\d{2}-?\d{8}-?\d(?!\d)"
#: The fiscal score as it is written plainly: patterns and points.
PLAIN = (
    (r"F\s*A\s*C\s*T\s*U\s*R\s*A|NOTA\s+DE\s+(?:CREDITO|DEBITO)", 5), (r"\b(?:FC|NC|ND)[ABC]\b", 5), (rf"\bFA\s*[-_/\"' ]*[ABC]\s*[-_/\"' ]*{PAIR}\b", 5), (r"\b(?:PUNTO DE VENTA|COMP\.?\s*NRO)\b", 3), (r"\bC\s*\.?\s*A\s*\.?\s*E\s*\.?\b", 4),
    (rf"CUIT|{ID}", 1), (r"RESPONSABLE INSCRIPTO|\bIVA\b", 1), (r"\b(?:TOTAL A PAGAR|IMPORTE TOTAL|TOTAL EXPENSAS|TOTAL)\b", 1), (r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b|\b\d{1,2}\s+\d{1,2}\s+20\d{2}\b", 1),
)
NUMBERED = ((rf"\b[ABCEMT]\s*{PAIR}\b", 4), (rf"\b(?:FACTURA|NOTA\s+(?:DE\s+)?(?:CREDITO|DEBITO))\s+{PAIR}\b", 4), (rf"\bN[ROº°]*\s*[:;,.-]?\s*{PAIR}\b", 3))
PIECES = (
    "FACTURA", "F A C T U R A", "NOTA DE CREDITO", "NOTA DEBITO", "FCA", "NDB", "NCX", "FA-A", "FA", "A", "X", "PUNTO DE VENTA", "COMP.NRO", "COMP NRO", "C.A.E.", "C A E", "CAE", "CUIT", "30-12345678-9", "30123456789", "130123456789", "RESPONSABLE INSCRIPTO",
    "IVA", "IVA 21%", "TOTAL", "SUBTOTAL", "TOTAL A PAGAR", "IMPORTE TOTAL", "TOTALES", "1/2/2024", "01-02-2024", "101/02/2024", "1 2 2024", "1 2 1924", "0001-00000002", "12/34", "N", "NRO.", "N°", SHARED, "RECIBO OFICIAL", "N RECIBO", "NRO.RECIBO", "N° RECIBO",
    "ORDEN DE PAGO", "ORDEN PAGO", "OP 1-2", "OP1-2", "XOP1-2", "XOP 1/2", "COMPROBANTE DE PAGO", "NO ES COMPROBANTE DE PAGO", "NO CONSTITUYE", "COMPROBANTEDEPAGO", "PAGO REALIZADO", "IMPORTE PAGADO", "IMPORTE PAGADOS",
)


def plain_score(t):
    shared = SHARED in t and all(re.search(p, t) for p in (SHARED_NUMBER, SHARED_VAT, rf"\bCUIT\b.{{0,80}}?{ID}"))
    return sum(n for p, n in PLAIN if re.search(p, t)) + next((n for p, n in NUMBERED if re.search(p, t)), 0) + 6 * bool(shared)


def plain_payment(t):
    """What the first rules of the decision list look for."""
    if re.search(r"\bRECIBO\s+OFICIAL\b|\bN\s*[°º]?\s*RECIBO\b|\bNRO\.?\s*RECIBO\b", t):
        return "remito_recibo"
    if plain_score(t) < 8 and re.search(r"\bORDEN(?:\s+DE)?\s+PAGO\b|\bOP\s*\d{1,5}\s*[-/]\s*\d+|OP\d{1,5}-\d+", t):
        return "orden_pago"
    kept = re.sub(r"\b(?:NO\s+ES|NO\s+CONSTITUYE|NO\s+REVISTE\s+CARACTER\s+DE)\s+COMPROBANTE\s+DE\s+PAGO\b", " ", t)
    if plain_score(t) < 8 and re.search(r"\bCOMPROBANTE\s+DE\s+PAGO\b|COMPROBANTEDEPAGO|\bPAGO\s+REALIZADO\b|\bIMPORTE\s+PAGADO\b", kept):
        return "comprobante_pago"
    return None


def test_scores_as_by_plain_patterns(spark):
    rnd = random.Random(3)
    texts = ["", *PIECES, *("".join(x for _ in range(rnd.randint(1, 6)) for x in (rnd.choice(PIECES), rnd.choice((" ", " ", " ", "", "-", ". ")))).strip() for _ in range(3000))]
    texts = [" ".join(t.split()) for t in texts]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "k long, text string, name string")
    rows = classify.with_category(docs).orderBy("k").collect()
    # Without accents and in upper case, as the rules see them.
    seen = [" ".join(t.replace("º", "o").upper().split()) for t in texts]
    assert [(t, r["invoice_score"]) for t, r in zip(seen, rows, strict=True)] == [(t, plain_score(t)) for t in seen]
    wanted = [(t, plain_payment(t)) for t in seen]
    first = [(t, r["category"] if r["category"] in ("orden_pago", "comprobante_pago") or r["reason"] == "recibo explícito" else None) for t, r in zip(seen, rows, strict=True)]
    assert first == wanted and len({w for _, w in wanted}) == 4


def test_terms_are_an_array(spark):
    """The plan does not write out a contains() for each term."""
    docs = spark.createDataFrame([("la", ""), ("", None)], "text string, name string")
    plan = classify.with_category(docs).select("category")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Contains\(", plan)) < 60
    found = spark.createDataFrame([("SALDO ANTERIOR Y DEBE",), ("",)], "t string").select(hits(F.col("t"), ("SALDO", "SALDO ANTERIOR", "DEBE", "HABER")).alias("n"), hits(F.col("t"), ()).alias("none"))
    assert [tuple(r) for r in found.collect()] == [(3, 0), (0, 0)]
