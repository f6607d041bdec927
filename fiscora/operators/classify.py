"""Classification of documents by additive rules.

Rules are rows: category, field, points, how hits count, and terms or patterns. Plain terms become
contains(), which is far cheaper than a pattern, over arrays of terms: written out one by one they
make one long method, which took twice as long. Patterns begin with a character (cascade.word), and
those of the decision list run where a text holds what all of them need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.functions.cascade import hits, pattern_hits, points, word
from fiscora.functions.text import upper_collapsed
from fiscora.operators.header import PAIR, SHARED, SHARED_NUMBER, SHARED_VAT

CATEGORIES = ("altas_bajas", "liquidaciones", "recibos_sueldo", "lista_precios", "menus", "estado_cuenta", "remito_recibo", "instructivo", "retenciones_transferencias", "administrativo", "comunicaciones", "impuestos_servicios", "operativo", "consorcio", "comprobante_pago")
STRONG = ("instructivo", "lista_precios", "retenciones_transferencias", "remito_recibo", "consorcio", "impuestos_servicios", "operativo", "estado_cuenta")


@dataclass(frozen=True)
class Rule:
    category: str
    field: str  # name, content or joined
    points: int
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    once: bool = False  # points for any hit, not for each


#: The rules.
RULES = (
    Rule("altas_bajas", "name", 5, ("ALTA ARCA", "BAJA ARCA", "ALTA TEMPRANA")),
    Rule("altas_bajas", "name", 8, patterns=(r"^ALTAS?\b", r"^BAJAS?\b")),
    Rule("altas_bajas", "content", 4, ("ALTA TEMPRANA", "BAJA TEMPRANA")),
    Rule("liquidaciones", "name", 8, ("LIQUIDACION", "LIQ FINAL", "1 SAC", "SAC")),
    Rule("liquidaciones", "content", 7, ("LIQUIDACION DE SUELDOS", "LIQUIDACION FINAL")),
    Rule("liquidaciones", "joined", 3, ("SUELDO", "VACACIONES", "INDEMNIZACION")),
    Rule("recibos_sueldo", "name", 6, ("LEGAJO", "EMPLEADO", "EMPLEADOR")),
    Rule("recibos_sueldo", "content", 8, ("RECIBO DE HABERES", "RECIBO DE SUELDO")),
    Rule("recibos_sueldo", "joined", 4, ("REMUNERACION", "APORTES", "CONTRIBUCIONES")),
    Rule("lista_precios", "name", 8, ("LISTA DE PRECIOS", "LISTAS DE PRECIOS")),
    Rule("lista_precios", "content", 9, ("LISTA DE PRECIOS", "LISTA DE PRECIOS ACTUALIZADA")),
    Rule("lista_precios", "content", 10, patterns=(r"L\s+I\s+S\s+T\s+A\s+D\s+E\s+P\s+R\s+E\s+C\s+I\s+O\s+S",)),
    Rule("lista_precios", "name", 5, patterns=(r"^LISTA\b", r"\bLISTA\s+ACEITES\b")),
    Rule("lista_precios", "content", 2, ("CODIGO", "PRESENTACION", "PRECIO", "PRECIO SUGERIDO", "$ X BOTELLA", "$ X UNID")),
    Rule("menus", "name", 8, ("MENU", "CARTA", "VINOSCARTAFINAL")),
    Rule("menus", "content", 5, ("MENU", "CARTA DE VINOS", "PLATOS", "COCTELES")),
    Rule("estado_cuenta", "name", 8, ("CTA CTE", "CTA_CTE", "CUENTA CORRIENTE", "ESTADO DE CUENTA")),
    Rule("estado_cuenta", "content", 7, ("ESTADO DE CUENTA", "CUENTA CORRIENTE")),
    Rule("estado_cuenta", "content", 2, ("SALDO ANTERIOR", "DEBE", "HABER", "SALDO")),
    Rule("estado_cuenta", "content", 8, ("COMPOSICION DE SALDOS",)),
    Rule("remito_recibo", "name", 7, patterns=(r"^INV-\d+", r"^REMITO[_ -]", r"^RECIBO[_ -]")),
    Rule("remito_recibo", "content", 8, ('RECIBO "X"', "RECIBO X", "REMITO")),
    Rule("remito_recibo", "content", 10, ("DOCUMENTO NO VALIDO COMO FACTURA", "RECIBO OFICIAL")),
    Rule("instructivo", "name", 9, ("INSTRUCTIVO", "MANUAL DE", "GUIA DE")),
    Rule("instructivo", "content", 7, ("INSTRUCTIVO", "PASO A PASO", "INSTRUCCIONES")),
    Rule("retenciones_transferencias", "name", 7, ("RETENCION", "TRANSFERENCIA")),
    Rule("retenciones_transferencias", "content", 10, ("CERTIFICADO DE RETENCION", "COMPROBANTE DE TRANSFERENCIA")),
    Rule("retenciones_transferencias", "joined", 3, ("GANANCIAS", "INGRESOS BRUTOS", "SIRCREB")),
    Rule("administrativo", "name", 8, ("ENCUESTA", "CALENDARIO", "ORDEN_TRABAJO", "ORDEN DE TRABAJO", "CHANGEREPORT")),
    Rule("administrativo", "content", 6, ("ENCUESTA DE SATISFACCION", "ORDEN DE TRABAJO")),
    Rule("comunicaciones", "name", 9, ("NOTA A CLIENTES", "COMUNICACION A CLIENTES", "CIRCULAR A CLIENTES")),
    Rule("comunicaciones", "content", 8, ("COMUNICACION A CLIENTES", "PROGRAMA DE INTEGRIDAD")),
    Rule("comunicaciones", "content", 3, ("CODIGO DE ETICA", "POLITICA ANTICORRUPCION", "SALUDAMOS A UDS")),
    Rule("impuestos_servicios", "joined", 10, ("INMOBILIARIO Y ABL", "IMPUESTO INMOBILIARIO", "ALUMBRADO BARRIDO LIMPIEZA")),
    Rule("operativo", "name", 10, ("MEP PLAZAS",)),
    Rule("operativo", "content", 6, ("PREPARACIONES PRODUCIR", "CANTIDAD DE RECETA", "PLAZA 1")),
    Rule("consorcio", "name", 10, ("CCF 000", "CCF_000")),
    Rule("consorcio", "content", 10, ("LIQUIDACION DE GASTOS COMUNES", "CONSORCIO COPROPIETARIOS")),
    # By the name alone, added to the above.
    Rule("comprobante_pago", "name", 12, ("COMPROBANTE DE PAGO",), once=True),
    Rule("retenciones_transferencias", "name", 10, ("TRANSFERENCIA",), once=True),
    Rule("administrativo", "name", 10, ("PAGO DE SERVICIOS",), once=True),
    Rule("consorcio", "name", 12, patterns=(r"^CCF[ _]",), once=True),
    Rule("operativo", "name", 12, ("MEP PLAZAS",), once=True),
    Rule("impuestos_servicios", "name", 12, ("INMOBILIARIO Y ABL",), once=True),
    Rule("remito_recibo", "name", 12, patterns=(r"^RDRC",), once=True),
)


def fiscal_score(c: Column) -> Column:
    """K1, over text and name together."""
    shared = F.contains(c, F.lit(SHARED)) & c.rlike(SHARED_NUMBER) & c.rlike(SHARED_VAT) & c.rlike(word(r"CUIT\b.{0,80}?(?<!\d)\d{2}-?\d{8}-?\d(?!\d)"))
    numbered = F.when(c.rlike(rf"[ABCEMT](?<=\b[ABCEMT])\s*{PAIR}\b"), 4).when(c.rlike(rf"(?:{word('FACTURA')}|{word(r'NOTA\s+(?:DE\s+)?(?:CREDITO|DEBITO)')})\s+{PAIR}\b"), 4).when(c.rlike(word(rf"N[ROº°]*\s*[:;,.-]?\s*{PAIR}\b")), 3).otherwise(0)
    day = r"\d(?<=\b\d)\d?"
    rules = (
        (c.rlike(r"F\s*A\s*C\s*T\s*U\s*R\s*A|NOTA\s+DE\s+(?:CREDITO|DEBITO)"), 5),
        (c.rlike(r"(?:F(?<=\bF)C|N(?<=\bN)[CD])[ABC]\b"), 5),
        (c.rlike(word(rf"FA\s*[-_/\"' ]*[ABC]\s*[-_/\"' ]*{PAIR}\b")), 5),
        (c.rlike(rf"(?:{word('PUNTO DE VENTA')}|{word(r'COMP\.?\s*NRO')})\b"), 3),
        (c.rlike(word(r"C\s*\.?\s*A\s*\.?\s*E\s*\.?\b")), 4),
        (F.contains(c, F.lit("CUIT")) | c.rlike(r"\d(?<!\d\d)\d-?\d{8}-?\d(?!\d)"), 1),
        (F.contains(c, F.lit("RESPONSABLE INSCRIPTO")) | c.rlike(word(r"IVA\b")), 1),
        (c.rlike(word(r"TOTAL\b")), 1),  # alone, to be paid, of an amount or of shared expenses
        (c.rlike(rf"{day}[./-]\d{{1,2}}[./-]\d{{4}}\b|{day}\s+\d{{1,2}}\s+20\d{{2}}\b"), 1),
        (shared, 6),
    )
    return points(rules) + numbered


def category_score(category: str, fields: dict[str, Column], house: tuple[Rule, ...] = ()) -> Column:
    """K2-K6: the points of one category; house: rules of a single house."""
    content, name, joined = fields["content"], fields["name"], fields["joined"]
    total = F.lit(0)
    for rule in (*RULES, *house):
        if rule.category == category:
            n = hits(fields[rule.field], rule.terms) + pattern_hits(fields[rule.field], rule.patterns)
            total = total + (F.when(n > 0, rule.points).otherwise(0) if rule.once else n * rule.points)
    has = lambda c, *terms: hits(c, terms) > 0
    extra = {
        "altas_bajas": ((has(name, "ALTA ARCA", "BAJA ARCA") & has(name, "EMPLEADO"), 4), (has(joined, "ARCA") & joined.rlike(r"\bALTA\b|\bBAJA\b"), 5)),
        "menus": ((has(content, "PRECIO") & has(joined, "MENU", "CARTA"), 2),),
        "remito_recibo": ((has(joined, "INV-") & has(content, "RECIBO X"), 5),),
        "instructivo": ((has(name, "ACCESO") & has(name, "FACTURA YA"), 12),),
    }
    return total + points(extra.get(category, ()))


def with_category(docs: DataFrame, text: str = "text", name: str = "name", house: tuple[Rule, ...] = ()) -> DataFrame:
    """docs with category, invoice_score, price_list_score, scores, confidence and reason (K8).

    The decision list: an explicit receipt; a payment if the fiscal score is below 8; an invoice from
    10; a strong category from 10; an invoice from 8; the best category from 8 with a margin of 3;
    else unknown. Ties go to the category that stands first."""
    content, own = upper_collapsed(F.col(text)), upper_collapsed(F.col(name))
    staged = docs.withColumns({"_c": content, "_n": own}).withColumn("_j", F.trim(F.concat_ws(" ", "_c", "_n")))
    fields = {"content": F.col("_c"), "name": F.col("_n"), "joined": F.col("_j")}
    ranked = F.array(*[F.struct(category_score(c, fields, house).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, c in enumerate(CATEGORIES)])
    staged = staged.withColumns({"invoice_score": fiscal_score(F.col("_j")), "_ranked": F.sort_array(ranked, asc=False)})
    joined = F.col("_j")
    held = lambda *terms: hits(joined, terms) > 0
    receipt = held("RECIBO") & joined.rlike(rf"{word(r'RECIBO\s+OFICIAL')}\b|{word(r'N\s*[°º]?\s*RECIBO')}\b|{word(r'NRO\.?\s*RECIBO')}\b")
    order = joined.rlike(rf"{word(r'ORDEN(?:\s+DE)?\s+PAGO')}\b|{word(r'OP\s*\d{1,5}\s*[-/]\s*\d+')}|OP\d{{1,5}}-\d+")
    unpaid = rf"(?:{word(r'NO\s+ES')}|{word(r'NO\s+CONSTITUYE')}|{word(r'NO\s+REVISTE\s+CARACTER\s+DE')})\s+COMPROBANTE\s+DE\s+PAGO\b"
    paid = held("PAGO", "PAGADO") & F.regexp_replace(joined, unpaid, " ").rlike(rf"{word(r'COMPROBANTE\s+DE\s+PAGO')}\b|COMPROBANTEDEPAGO|{word(r'PAGO\s+REALIZADO')}\b|{word(r'IMPORTE\s+PAGADO')}\b")
    strongest = F.get(F.filter("_ranked", lambda x: x["category"].isin(*STRONG)), F.lit(0))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    score = F.col("invoice_score")
    settled = (best["score"] >= 8) & (best["score"] - second["score"] >= 3)
    decided = [
        (receipt, F.lit("remito_recibo"), "recibo explícito"),
        ((score < 8) & order, F.lit("orden_pago"), "documento de pago"),
        ((score < 8) & paid, F.lit("comprobante_pago"), "documento de pago"),
        (score >= 10, F.lit("factura"), "evidencia fiscal fuerte"),
        (strongest["score"] >= 10, strongest["category"], "categoría prioritaria"),
        (score >= 8, F.lit("factura"), "evidencia fiscal suficiente"),
        (settled, best["category"], "evidencia no ambigua"),
    ]
    category, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for rule, value, why in decided:
        category, reason = category.when(rule, value), reason.when(rule, why)
    out = staged.withColumns({
        "category": category.otherwise("desconocido"),
        "reason": reason.otherwise("sin evidencia suficiente"),
        "price_list_score": F.get(F.filter("_ranked", lambda x: x["category"] == "lista_precios"), F.lit(0))["score"],
        "scores": F.map_from_arrays("_ranked.category", "_ranked.score"),
        "_best": best["score"],
    })
    return out.withColumn("confidence", F.when(F.col("category") != "desconocido", "alta").when(F.col("_best") == 0, "ninguna").otherwise("baja")).drop("_c", "_n", "_j", "_ranked", "_best")
