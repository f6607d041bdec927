"""Fiscal header of a document: type, letter, number, issue date, code.

Every step is a Column expression over the text normalised once. Where all matches count, and what
stands left of each, one expression extracts (text since the last date, date) pairs and array
functions pick the first acceptable one, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.functions.cascade import ahead, bind, document_number, first_match, group, number_by
from fiscora.functions.dates import DATE, MONTHS, from_parts, header_date, told, year_repaired
from fiscora.functions.text import clean_lines, upper_collapsed

INVOICE, CREDIT, DEBIT = "FACTURA", "NOTA DE CREDITO", "NOTA DE DEBITO"
#: Fiscal codes and the prefixes of types.
CODES = {1: (INVOICE, "A"), 2: (DEBIT, "A"), 3: (CREDIT, "A"), 6: (INVOICE, "B"), 7: (DEBIT, "B"), 8: (CREDIT, "B"), 11: (INVOICE, "C"), 12: (DEBIT, "C"), 13: (CREDIT, "C")}
PREFIXES = {INVOICE: "FC", CREDIT: "NC", DEBIT: "ND"}
#: Patterns of the header. Order matters: credit notes, debit notes, invoices.
NEGATED = ahead("ND", r"\bNO\s+ES\s+FACTURA\b|\bNO\s+CORRESPONDE\s+A\s+FACTURA\b|\bDOCUMENTO\s+DE\s+TRASLADO\s*[-:]?\s*NO\s+ES\s+FACTURA\b")
TYPES = (
    (CREDIT, ahead("N", r"\bNOTA\s+(?:DE\s+)?CREDITO\b|\bN\s*/\s*C\b|\bNC\s*[-_/ ]*[ABC]\b")),
    (DEBIT, ahead("N", r"\bNOTA\s+(?:DE\s+)?DEBITO\b|\bN\s*/\s*D\b|\bND\s*[-_/ ]*[ABC]\b")),
    (INVOICE, ahead("F", r"\bFACTURA\b|F\s*A\s*C\s*T\s*U\s*R\s*A|\bFC\s*[-_/ ]*[ABC]\b|\bFAC\s*[-_/ ]*[ABC]\b|\bFA\s*[-_/\"']+[ABC]\b")),
)
ANY_TITLE = r"(?:FACTURA|NOTA\s+(?:DE\s+)?CREDITO|NOTA\s+(?:DE\s+)?DEBITO)"
PAIR = r"(\d{1,5})\s*[-/]\s*(\d{1,8})"
SHARED = "LIQUIDACION DE GASTOS COMUNES"
SHARED_NUMBER = ahead("N", rf"\bN[ROº°]*\.?\s*[:;,.-]?\s*{PAIR}\b")
SHARED_VAT = r"\bIVA\s+(?:21|27)\s*%"
LETTERS = (
    ahead("FN", rf"\b{ANY_TITLE}\s*[-:]?\s*([ABC])\b"),
    ahead("ABC", rf"\b([ABC])\s+(?:COD(?:IGO)?\.?\s*0*\d{{1,3}}\s+)?{ANY_TITLE}\b"),
    ahead("FN", r"\b(?:FC|FAC|NC|ND)\s*[-_/ ]*([ABC])\b"),
    ahead("F", r"\bFA\s*[-_/\"']+([ABC])\b"),
    ahead("L", r"\bLETRA\s*[:\-]?\s*([ABC])\b"),
)
CODE = ahead("CT", r"(?:COD(?:IGO)?|TIPO)\.?\s*(?:N(?:RO)?\.?\s*)?[:\-]?\s*0*(\d{1,3})\b")
NUMBER_LABEL = r"(?:NRO\.?|NUMERO|NO\.?)"
FORM_LABEL = rf"(?:COMP(?:ROBANTE)?\.?\s*)?{NUMBER_LABEL}"
POINT_LABEL = r"(?:PTO\.?\s*(?:DE\s*)?VTA\.?|PUNTO\s+DE\s+VENTA)"
NUMBERS = (
    ahead("F", rf"\bFACTURA\s+{PAIR}\b"),
    ahead("F", rf"\bFA\s*[-_/\"' ]*[ABC]\s*[-_/\"' ]*{PAIR}\b"),
    ahead("FN", rf"\b{ANY_TITLE}(?:\s+[ABC])?.{{0,40}}?{FORM_LABEL}\s*[:\-]?\s*{PAIR}"),
    ahead("CN", rf"\b{FORM_LABEL}\s*[:\-]?\s*{PAIR}"),
    ahead("FN", r"\b(?:FC|NC|ND)\s*[-_/ ]*[ABC]\s*[-_/ ]*(\d{1,5})\s*[-_/]\s*(\d{1,8})\b"),
    ahead("P", rf"{POINT_LABEL}\s*[:\-]?\s*(\d{{1,5}}).{{0,100}}?\bCOMP(?:ROBANTE)?(?:\s+NRO\.?)?\s*[:\-]?\s*(\d{{1,8}})\b"),
    ahead("P", rf"{POINT_LABEL}\s*[:\-]?\s*{FORM_LABEL}\s*[:\-]?\s*(\d{{1,5}})\s+(\d{{1,8}})"),
    ahead("P", rf"{POINT_LABEL}\s*[:\-]?\s*(\d{{1,5}}).{{0,180}}?{FORM_LABEL}\s*[:\-]?\s*(\d{{1,8}})"),
    ahead("N", rf"\b{NUMBER_LABEL}\s*[:\-]?\s*{PAIR}\b"),
)
RELATED = ahead("CFNDR", r"\b(?:COMPROBANTE|FACTURA|NOTA)\s+(?:ASOCIAD[AO]|RELACIONAD[AO]|ORIGINAL)\b|\b(?:DOCUMENTO|REFERENCIA)\s+(?:ASOCIAD[AO]|RELACIONAD[AO])\b")
OWN_NUMBER = ahead("N", rf"\b(?:NRO\.?|NUMERO|NO\.?)(?:\s+DEL\s+COMPROBANTE|\s+DE\s+ESTA\s+NOTA\s+DE\s+(?:CREDITO|DEBITO))?\s*[:\-]?\s*{PAIR}\b")
#: Labels that take a date away from the issue date.
OTHER_DATES = r"INICIO DE ACTIVIDADES|INICIO ACTIVIDADES|FECHA DE INICIO|VENCIMIENTO|VENC|VTO|CAE|ENTREGA|PERIODO FACTURADO"
HEADER_ENDS = r"\b(?:RECEPTOR|CLIENTE|DESTINATARIO|SENOR CONSORCISTA)\b"


def has_pair(c: Column) -> Column:
    return c.rlike(SHARED_NUMBER)


def document_type(norm: Column) -> Column:
    """E1, over text normalised by upper_collapsed."""
    text = F.regexp_replace(norm, NEGATED, " ")
    support = text.rlike(r"\b\d{1,5}\s*[-/]\s*\d{1,8}\b") & text.rlike(r"\b(?:CAE|CUIT|IVA)\b")
    out = F.when(F.lit(False), "")
    for kind, pattern in TYPES:
        out = out.when(text.rlike(pattern), kind)
    out = out.when(support & text.rlike(ahead("T", r"\bTOTAL\s+(?:NOTA\s+DE\s+)?CREDITO\b")), CREDIT).when(support & text.rlike(ahead("T", r"\bTOTAL\s+(?:NOTA\s+DE\s+)?DEBITO\b")), DEBIT)
    return out.when(F.contains(text, F.lit(SHARED)) & has_pair(text) & text.rlike(SHARED_VAT) & text.rlike(r"\bCUIT\b"), INVOICE)


def fiscal_code(kind: Column, letter: Column) -> Column:
    """FC, NC or ND with A, B or C; null for anything else."""
    prefix = F.when(F.lit(False), "")
    for name, short in PREFIXES.items():
        prefix = prefix.when(kind == name, short)
    return F.when(letter.isin("A", "B", "C"), F.concat(prefix, letter))


def _by_code(norm: Column, kind: Column) -> Column:
    """The letter of the first code that belongs to the type."""
    table = F.when(F.lit(False), "")
    found = F.regexp_extract_all(norm, F.lit(CODE), F.lit(1))

    def letter(x: Column) -> Column:
        out = table
        for code, (name, own) in CODES.items():
            out = out.when((x.cast("int") == code) & (kind == name), own)
        return out

    return F.get(F.filter(F.transform(found, letter), lambda x: x.isNotNull()), F.lit(0))


def _alone(raw: Column, norm: Column) -> Column:
    """A single letter on a line of its own, or at the end of one, above the receiver's block."""
    lines = F.slice(F.split(clean_lines(raw), "\n"), 1, 20)
    upper = F.transform(lines, lambda x: upper_collapsed(x, True))
    cut = F.array_position(F.transform(upper, lambda x: x.rlike(HEADER_ENDS)), F.lit(True))
    head = F.when(cut > 0, F.slice(upper, 1, F.greatest(cut - 1, F.lit(0)).cast("int"))).otherwise(upper)
    support = F.array_join(head, " ").rlike(r"\b(?:FACTURA|NOTA|NUMERO|NRO|CAE|CUIT|IVA|TOTAL\s+(?:CREDITO|DEBITO))\b") & norm.rlike(r"\b\d{4,5}\s*[-/]\s*\d{6,8}\b")
    letters = F.transform(head, lambda x: F.when(x.isin("A", "B", "C"), x).when(x.rlike(r"S\s*\.\s*A\s*\.?\s*$") | ~x.rlike(r"\s"), None).otherwise(group(x, r"\b([ABC])\s*$")))
    found = F.array_distinct(F.filter(letters, lambda x: x.isNotNull()))
    return F.when(support & (F.size(found) == 1), F.get(found, F.lit(0)))


def document_letter(raw: Column, norm: Column, kind: Column) -> Column:
    """E2."""
    shared = F.contains(norm, F.lit(SHARED)) & has_pair(norm) & norm.rlike(SHARED_VAT) & norm.rlike(r"(?:^|\s)A(?:\s|$)|\bA\s*[\"']A[\"']\s")
    typed = F.coalesce(_by_code(norm, kind), _alone(raw, norm), F.when(shared, "A"), group(norm, ahead("ABC", rf"\b([ABC])\s*{PAIR}\b")))
    return F.coalesce(first_match(norm, LETTERS), F.when(kind.isNotNull(), typed))


def _own_number(norm: Column, title: str) -> Column:
    """A note's own number: behind its title and before any related document."""
    shape = r"\b(?:[ABC]\s*)?(\d{1,5})\s*[-/]\s*(\d{4,8})\b"

    def own(tail: Column) -> Column:
        before = F.transform(F.split(tail, shape), lambda x: F.substring(x, -32, 32))
        parts = [F.regexp_extract_all(tail, F.lit(shape), F.lit(i)) for i in (1, 2)]
        free = F.filter(F.arrays_zip(before, *parts), lambda x: x["1"].isNotNull() & ~x["0"].rlike(r"\b(?:CUIT|FECHA|VENC|VTO)\b"))
        first = bind(F.get(free, F.lit(0)), lambda x: document_number(x["1"], x["2"]))
        return F.coalesce(number_by(tail, OWN_NUMBER), first)

    tail = bind(F.regexp_extract(norm, ahead("N", rf"{title}(.{{0,320}})"), 1), lambda x: F.get(F.split(x, RELATED), F.lit(0)))
    return bind(tail, lambda t: F.when(t != "", own(t)))


def number(norm: Column, kind: Column) -> Column:
    """E3."""
    notes = F.when(kind == CREDIT, _own_number(norm, r"NOTA\s+(?:DE\s+)?CREDITO")).when(kind == DEBIT, _own_number(norm, r"NOTA\s+(?:DE\s+)?DEBITO"))
    last = F.when(kind == INVOICE, number_by(norm, ahead("ABC", rf"\b[ABC]\s*{PAIR}\b")))
    return F.coalesce(notes, *[number_by(norm, p) for p in NUMBERS], last)


def _parts_date(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), header_date(F.concat_ws("/", *[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)])))


def _dates(norm: Column) -> Column:
    """Each date with what stands before it (up to the last date, 70 characters) and after it."""
    # Split at the dates: a pattern that reaches 70 characters back costs that at every character.
    after = rf"({DATE})(?=(.{{0,110}}))"
    before = F.transform(F.split(norm, DATE), lambda x: F.regexp_replace(F.substring(x, -70, 70), "(?s)^.*[\u0085\u2028\u2029]", ""))
    parts = [F.regexp_extract_all(norm, F.lit(after), F.lit(i)) for i in (1, 2)]
    rows = F.filter(F.arrays_zip(before, *parts), lambda x: x["1"].isNotNull())
    return F.filter(rows, lambda x: ~x["0"].rlike(OTHER_DATES))


def issue_date(norm: Column, kind: Column, confirmed: bool = False) -> Column:
    """From the most to the least certain context."""
    worded = ahead("FB", rf"(?:FACTURA.{{0,80}}?|BS[.]?AS[.]?,?\s*)(\d{{1,2}})\s+DE\s+({'|'.join(MONTHS)})\s+DE\s+(\d{{4}})")
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    textual = F.when(F.contains(norm, F.lit(" DE ")), from_parts(F.regexp_extract(norm, worded, 3).try_cast("int"), F.try_element_at(month, F.regexp_extract(norm, worded, 2)), F.regexp_extract(norm, worded, 1).try_cast("int")))
    tight = F.regexp_replace(norm, r"\s+", "")
    compact = F.regexp_extract(tight, r"[ABC]\d{4,5}-\d{8}(\d{6}|\d{8})", 1)
    compact_date = header_date(F.when(compact != "", F.concat_ws("/", F.substring(compact, 1, 2), F.substring(compact, 3, 2), F.substring(compact, 5, 4))))
    block = rf"PERIODO\s+FACTURADO\s+DESDE:.{{0,80}}?HASTA:.{{0,80}}?FECHA\s+DE\s+VTO\.?\s+PARA\s+EL\s+PAGO:.{{0,500}}?{DATE}\s+{DATE}\s+{DATE}\s+({DATE})"

    def first(rows: Column) -> Column:
        return F.get(F.filter(F.transform(rows, lambda x: header_date(x["1"])), lambda d: d.isNotNull()), F.lit(0))

    def contextual(usable: Column) -> Column:
        titled = first(F.filter(usable, lambda x: x["2"].rlike(r"^.{0,80}?\b(?:FACTURA|NOTA\s+DE\s+(?:CREDITO|DEBITO))\b")))
        labelled = first(F.filter(usable, lambda x: x["0"].rlike(r"\bFECHA\b\s*[:\-]?\s*$")))
        return F.coalesce(titled, labelled, F.when(fiscal, first(usable)))

    fiscal = kind.isNotNull() | F.lit(confirmed)
    squeezed = F.get(F.filter(F.transform(F.regexp_extract_all(tight, F.lit(f"({DATE})"), F.lit(1)), header_date), lambda d: d.isNotNull()), F.lit(0))
    strong = [
        textual,
        _parts_date(norm, ahead("F", r"\bFACTURA\s+\d{1,5}\s*[-/]\s*\d{1,8}.{0,80}?(\d{1,2})\s+(\d{1,2})\s+(\d{4})\b")),
        _parts_date(norm, r"(\d{1,2})\s+(\d{1,2})\s+(\d{4})(?=.{0,40}?\bFECHA\b)"),
        _parts_date(norm, ahead("F", r"\bFECHA\b\s*[:;,.\-]?\s*(\d{1,2})\s+(\d{1,2})\s+(\d{4}|\d{2})\b")),
        _parts_date(norm, ahead("ABC", r"\b[ABC]\s*\d{4,5}\s*[- ]\s*\d{8}\s+(\d{1,2})\s+(\d{1,2})\s+(\d{4}|\d{2})\b")),
        compact_date,
        *[header_date(F.regexp_extract(norm, ahead("F", rf"\b{label}\b\s*[:\-]?\s*({DATE})"), 1)) for label in (r"FECHA\s+DE\s+EMISION", r"FECHA\s+EMISION", r"FECHA\s+DEL\s+COMPROBANTE")],
    ]
    # The date in the service block is never repaired; the others are, by the due date.
    settled = F.when(F.contains(norm, F.lit("PERIODO")), header_date(F.regexp_extract(norm, block, 1)))
    rest = F.coalesce(bind(_dates(norm), contextual), F.when(fiscal, squeezed))
    repaired = lambda d: bind(d, lambda x: F.when(x.isNotNull(), year_repaired(x, norm)))
    return F.coalesce(repaired(F.coalesce(*strong)), settled, repaired(rest))


def with_header(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with document_type, fiscal_letter, document_number, issue_date, fiscal_code, supported and
    warnings (E6). Null and blank texts have nulls and all warnings."""
    staged = docs.withColumn("norm", upper_collapsed(F.col(text), True))
    staged = staged.withColumn("document_type", document_type(F.col("norm")))
    kind, norm = F.col("document_type"), F.col("norm")
    staged = staged.withColumns({"fiscal_letter": document_letter(F.col(text), norm, kind), "document_number": number(norm, kind), "issue_date": told(issue_date(norm, kind))})
    code = fiscal_code(kind, F.col("fiscal_letter"))
    missing = [F.when(F.col(c).isNull(), F.lit(w)) for c, w in (("document_type", "tipo no detectado"), ("fiscal_letter", "letra no detectada"), ("document_number", "numero no detectado"))]
    return staged.withColumn("fiscal_code", code).withColumn("supported", F.col("fiscal_code").isNotNull()).withColumn("warnings", F.array_compact(F.array(*missing))).drop("norm")


def missing_fields(date: str = "issue_date", kind: str = "document_type", letter: str = "fiscal_letter", num: str = "document_number", supplier: str = "supplier_name") -> Column:
    """C3: 'Faltan: ...' of what a document lacks, or null."""
    labels = ((date, "fecha"), (kind, "tipo"), (letter, "letra"), (num, "numero"), (supplier, "proveedor"))
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(n)) for c, n in labels]))
    return F.when(F.size(lacks) > 0, F.concat(F.lit("Faltan: "), F.array_join(lacks, ", ")))
