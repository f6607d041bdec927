"""Registered queries of the document engine and the SQL that checks them.

Extraction queries read rendered documents; their SQL computes the expected values from the source
columns, without any pattern matching, so that the two are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscora.functions import taxid, text
from fiscora.operators import amounts, classify, filename, files, fusion, header, issuer, record, run, suppliers
from fiscora.plans import documents as plans
from fiscora.plans import render
from fiscora.sources.documents import joined_pages
from fiscora.sources.scratch import materialised
from fiscora.sources.tables import read
from fiscora.streaming import history

FACTS = render.facts_sql()
INVOICES = render.invoices_sql()
RECEIVER_NAME = "RECEPTORA DE PRUEBA"
UPPER_FROM, UPPER_TO = text.ACCENTED + text.SIGNS, text.PLAIN + text.SIGNS_PLAIN


def _docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Rendered documents, dealt to all cores: each source table is one file. Exploded, so that a text is
    written once, not anew for each expression over it."""
    return _once(render.invoices(spark, sf_dir), *extra)


def _once(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select("doc_key", *extra, F.explode(F.array("text")).alias("text")).select("doc_key", "text", *extra)


# Rendered documents -------------------------------------------------------------------------------


def q_render_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.invoices(spark, sf_dir).select("doc_key", "name", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def q_header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = header.with_header(_docs(spark, sf_dir))
    return docs.select("doc_key", "document_type", "fiscal_letter", "document_number", "issue_date", "fiscal_code", "supported", F.size("warnings").cast("long").alias("n_warnings"))


def q_fiscal_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = header.with_header(_docs(spark, sf_dir, "total"))
    return docs.groupBy("fiscal_code").agg(F.count("*").alias("n_docs"), F.sum("total").cast("decimal(28,2)").alias("total"))


def q_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.with_amounts(_docs(spark, sf_dir)).select("doc_key", "subtotal", "taxes", "total_amount", F.col("total_amount_dec").alias("total_dec"))


def q_currency_cae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.with_amounts(_docs(spark, sf_dir)).select("doc_key", "currency", "cae", "cae_expiration", "issuer_tax_id", "receiver_tax_id")


def q_tax_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_key", F.array_join(taxid.valid_in(F.col("text")), ",").alias("ids"))


def q_tax_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = amounts.with_taxes(_docs(spark, sf_dir, "supplier_tax_id", F.col("legal_name").alias("supplier_name")))
    return amounts.tax_profile(docs)[0]


def q_tax_profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.profile_export(q_tax_profile(spark, sf_dir))


def q_tax_profile_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of suppliers that are found first: half of them by the catalogue, the others by the layout."""
    docs = materialised(_docs(spark, sf_dir, "name"), "rendered")
    known = _suppliers(spark, sf_dir).where("cast(substr(identifier, 11) AS int) % 2 = 0").withColumn("folder_name", F.lit(None).cast("string")).withColumn("display_name", F.col("legal_name"))
    found = plans.resolved(docs, known, render.RECEIVER_ID, RECEIVER_NAME, plans.Rules())
    profile = amounts.tax_profile(amounts.with_taxes(docs.join(found, "doc_key")))[0]
    by_layout = found.groupBy("supplier_tax_id").agg(F.bool_and(F.col("step") == plans.GENERIC).alias("by_layout"))
    return profile.join(by_layout, "supplier_tax_id")


def q_issuer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issuer.issuer_identity(_docs(spark, sf_dir), render.RECEIVER_ID, RECEIVER_NAME).select("doc_key", "tax_id", "name")


def q_issuer_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen families of layouts, some of which tell no issuer."""
    docs = render.issuer_pages(spark, sf_dir).select("doc_key", "text", "hint")
    return issuer.issuer_identity(docs, render.RECEIVER_ID, RECEIVER_NAME, hint="hint").select("doc_key", "tax_id", "name", "score")


def q_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two degraded readings: one without the number line in three of four documents, one without
    the date line in two of three."""
    docs = _once(_docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "Inicio.*\n", "")))
    first = F.struct(F.lit("psm_3").alias("method"), F.when(F.col("doc_key") % 4 != 0, F.regexp_replace("text", r"N[úu]?m?e?ro?[.:].*\n", "")).otherwise(F.col("text")).alias("text"))
    second = F.struct(F.lit("psm_6").alias("method"), F.when(F.col("doc_key") % 3 != 0, F.regexp_replace("text", r"(?i)Fecha.*\n", "")).otherwise(F.col("text")).alias("text"))
    # Both readings of one row, so that the documents are written once.
    passes = header.with_header(docs.select("doc_key", F.explode(F.array(first, second)).alias("p")).select("doc_key", "p.*"))
    passes = passes.withColumn("score", fusion.quality(F.col("text"), {f: F.col(f) for f in fusion.FIELDS}))
    return fusion.fused_fields(passes, ("document_type", "fiscal_letter", "document_number")).select("doc_key", "document_type", "fiscal_letter", "document_number")


#: Readings of one document: [text of pass psm_3, text of pass psm_6], and which method is due. The families
#: are: a half each, of which both make one; the second adds nothing; what the second adds makes no
#: better score than the first has alone; no text at all.
_TITLE_LINE = "concat(kind, ' ', letter, chr(10), 'Nro. ', document_number, chr(10))"
_DATE_LINES = "concat('Razón social: ', house, chr(10), 'CUIT: ', supplier_tax_id, chr(10), 'Fecha de Emisión: ', issue_date, chr(10), 'PUNTO DE VENTA 0001', chr(10), 'Inicio de actividades', chr(10))"
_READ = f"""SELECT doc_key, kind, letter, document_number, issue_date, house, supplier_tax_id,
  CASE doc_key % 4 WHEN 0 THEN concat({_TITLE_LINE}, 'IVA CAE TOTAL FACTURA') WHEN 1 THEN concat({_TITLE_LINE}, {_DATE_LINES}, 'IVA CAE TOTAL FACTURA') WHEN 2 THEN concat({_TITLE_LINE}, {_DATE_LINES}, 'IVA CAE TOTAL FACTURA') ELSE ' ' END AS a,
  CASE doc_key % 4 WHEN 0 THEN {_DATE_LINES} WHEN 1 THEN {_TITLE_LINE} WHEN 2 THEN 'apenas unas manchas' END AS b
FROM (SELECT *, concat('ALMACEN K', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' SRL') AS house FROM __facts__) AS f"""


def q_reading_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over the readings of each document, and the header of what it gives."""
    rows = spark.sql(_READ.replace("__facts__", "{facts}"), facts=render.facts(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism))
    passes = rows.select("doc_key", F.explode(F.array(F.struct(F.lit("psm_3").alias("method"), F.col("a").alias("text")), F.struct(F.lit("psm_6").alias("method"), F.col("b").alias("text")))).alias("p")).select("doc_key", "p.*")
    fused = fusion.fused_reading(passes, render.RECEIVER_ID, RECEIVER_NAME)
    return header.with_header(fused).select("doc_key", "method", "document_type", "fiscal_letter", "document_number", "issue_date", F.sha2("text", 256).alias("text_sha256"))


# Names and paths ----------------------------------------------------------------------------------

_STYLES = ("concat('FC A ', pv, '-', num, ' x.pdf')", "concat('NCB', pv, num, '.pdf')", "concat('FACC', pv, num, '_ORIG.pdf')", "concat('factura_ARCA_A_', pv, '-', num, '.pdf')", "concat('Comprobante-FCVTA-B-', point, '-', number_, '.pdf')", "concat('Nota de Crédito N° A-', pv, '-', num, '.pdf')", "concat('N_DA', pv, num, '.pdf')", "concat('Venta_A', pv, '-', num, '.pdf')", "concat('N CB', pv, num, '.pdf')", "concat('V072_FACT_A', pv, num, '.pdf')", "concat(tax_digits, '_C-', pv, '-', num, '.pdf')", "concat(tax_digits, '_011_', pv, '_', num, '.pdf')", "concat('Factura ', pv, '-', num, '.pdf')", "concat('lista ', num, '.pdf')")
_EXPECTED = (("FACTURA", "A", "nombre_con_tipo_letra_y_numero"), ("NOTA DE CREDITO", "B", "nombre_con_tipo_letra_y_numero"), ("FACTURA", "C", "nombre_fac_compacto"), ("FACTURA", "A", "nombre_factura_descriptiva"), ("FACTURA", "B", "nombre_fcvta"), ("NOTA DE CREDITO", "A", "nombre_nota_descriptiva"), ("NOTA DE DEBITO", "A", "nombre_nd_compacto"), ("FACTURA", "A", "nombre_factura_sistema_gestion"), ("NOTA DE CREDITO", "B", "nombre_nc_compacto_flexible"), ("FACTURA", "A", "nombre_fact_sap_compacto"), (None, "C", "nombre_cuit_letra_numero"), ("FACTURA", "C", "nombre_con_codigo_afip"), (None, None, "nombre_con_numero"), (None, None, None))
_NAMED = "CASE doc_key % 14 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_STYLES)) + " END"


def _case(values, otherwise: str = "NULL") -> str:
    return "CASE doc_key % 14 " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values) if v) + f" ELSE {otherwise} END"


def q_filename_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = render.facts(spark, sf_dir).selectExpr("*", "lpad(cast(point AS string), 5, '0') AS pv", "lpad(cast(number_ AS string), 8, '0') AS num")
    return facts.withColumn("name", F.expr(_NAMED)).select("doc_key", filename.evidence(F.col("name")).alias("e")).select("doc_key", "e.document_type", "e.fiscal_letter", "e.document_number", "e.method")


def q_name_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lacks the letter in half of the documents; the coded name overrides or fills it."""
    docs = render.invoices(spark, sf_dir).withColumn("e", filename.evidence(F.col("name")))
    content = F.when(F.col("doc_key") % 2 == 0, F.col("letter"))
    return docs.select("doc_key", filename.fused("document_type", F.lit("FACTURA"), F.col("e")).alias("document_type"), filename.fused("fiscal_letter", content, F.col("e")).alias("fiscal_letter"), filename.fused("document_number", F.lit(None).cast("string"), F.col("e")).alias("document_number"))


def q_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = render.facts(spark, sf_dir)
    name = filename.canonical_name(F.col("issue_date"), F.col("fiscal_code"), F.col("document_number"), F.lit("Receptora"), F.col("legal_name"))
    out = facts.select("doc_key", filename.folder(F.col("legal_name"), F.col("issue_date")).alias("folder"), name.alias("file_name"))
    return out.withColumn("fiscal_key", filename.fiscal_key(F.col("file_name")))


_BAD_DAY = "concat(substr(issue_date, 4, 2), '-', substr(issue_date, 1, 2))"
_GOOD_DAY = "concat(substr(issue_date, 1, 2), '-', substr(issue_date, 4, 2))"
_AUDITED = f"SELECT doc_key, CASE WHEN doc_key % 17 = 0 THEN NULL ELSE issue_date END AS issue_date, concat('root/PROVEEDOR_', cast(s_suppkey AS string), '/', substr(issue_date, 7, 4), '/', substr(issue_date, 4, 2), '/', CASE WHEN doc_key % 2 = 0 THEN {_GOOD_DAY} ELSE {_BAD_DAY} END, fiscal_code, document_number, '_R_P.pdf') AS path, concat('root/PROVEEDOR_', cast(s_suppkey AS string), '/', substr(issue_date, 7, 4), '/', substr(issue_date, 4, 2), '/', {_GOOD_DAY}, fiscal_code, document_number, '_R_P.pdf') AS target FROM (__facts__)"


def q_date_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_AUDITED.replace("(__facts__)", "{facts}"), facts=render.facts(spark, sf_dir))
    # A table first: both sides read it, and the audit's filter would be pushed into the facts' joins, where
    # its expressions, path in path, are written out again and again.
    rows = materialised(rows.select("path", "issue_date"), "audited")
    return files.date_audit(rows, rows.select("path"))


# Text, ids, classes -------------------------------------------------------------------------------


def q_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", F.sha2(text.search_key(F.col("text")), 256).alias("key_sha256"), F.sha2(text.upper_collapsed(F.col("text"), True), 256).alias("upper_sha256"))


def q_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", F.sha2(text.clean_lines(F.col("text")), 256).alias("lines_sha256"))


def q_path_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.path_token(F.col("text")).alias("token"))


def q_text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


def q_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    page = F.struct(F.col("turn").cast("int").alias("numero"), F.when(F.col("turn") % 3 != 2, F.col("text")).otherwise("").alias("texto"))
    docs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return joined_pages(docs).select("conv_id", F.sha2("text", 256).alias("text_sha256"), F.col("n_pages").cast("long"), F.col("n_text_pages").cast("long"), "has_text")


_IDS = f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat(substr({render.tax_id('s_suppkey')}, 1, 10), cast((cast(substr({render.tax_id('s_suppkey')}, 11, 1) AS int) + 1) % 10 AS string)) ELSE {render.tax_id('s_suppkey')} END AS d FROM __supplier__"


def q_tax_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_IDS.replace("__supplier__", "{supplier}"), supplier=read(spark, sf_dir, "supplier"))
    return rows.select("s_suppkey", taxid.valid(F.col("d")).alias("valid"), taxid.formatted(F.col("d")).alias("shown"), taxid.formatted_valid(F.col("d")).alias("shown_valid"))


_DROPPED = "SELECT doc_key, CASE WHEN doc_key % 2 = 0 THEN issue_date END AS issue_date, CASE WHEN doc_key % 3 = 0 THEN kind END AS document_type, CASE WHEN doc_key % 5 <> 0 THEN letter END AS fiscal_letter, CASE WHEN doc_key % 7 <> 0 THEN document_number ELSE '' END AS document_number, CASE WHEN doc_key % 2 = 0 THEN legal_name END AS supplier_name FROM __facts__"


def q_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_DROPPED.replace("__facts__", "{facts}"), facts=render.facts(spark, sf_dir))
    return rows.select("doc_key", header.missing_fields().alias("pending_reason"))


_CLASSED = "CASE doc_key % 7 WHEN 0 THEN text WHEN 1 THEN 'Lista de precios actualizada: presentación, precio sugerido' WHEN 2 THEN 'Liquidación de sueldos y vacaciones' WHEN 3 THEN 'Orden de pago número 7' WHEN 4 THEN 'Recibo oficial por la factura A 0001-00000002' WHEN 5 THEN 'Composición de saldos, saldo anterior, debe, haber' ELSE 'Texto sin nada' END"
_CLASSES = ("factura", "lista_precios", "liquidaciones", "orden_pago", "remito_recibo", "estado_cuenta", "desconocido")


def q_classify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.invoices(spark, sf_dir).select("doc_key", F.expr(_CLASSED).alias("text"), F.lit("archivo.pdf").alias("name"))
    return classify.with_category(docs).select("doc_key", "category", "confidence")


def q_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_classify_decision(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


# Suppliers ----------------------------------------------------------------------------------------

_SUPPLIERS = f"SELECT concat('proveedor_', cast(s_suppkey AS string)) AS identifier, concat('PROVEEDOR ', upper(replace(s_name, '#', ' ')), ' SA') AS legal_name, concat('Fantasía ', cast(s_suppkey AS string)) AS display_name, {render.tax_id('s_suppkey')} AS cuit FROM __supplier__"
#: A catalogue that lacks some of the suppliers.
_CATALOGUED = f"SELECT {render.tax_id('s_suppkey')} AS tax_id FROM __supplier__ WHERE s_suppkey % 2 = 0"
_RECEIVED = f"SELECT l_orderkey * 10 + l_linenumber AS row_no, {render.tax_id('l_suppkey')} AS tax_id, concat('Proveedor ', cast(l_suppkey % 40 AS string), CASE WHEN l_linenumber % 3 = 0 THEN ' SRL' ELSE ' SA' END) AS name, concat('F', l_returnflag) AS kind, CASE WHEN l_linestatus = 'O' THEN '$' ELSE 'U$S' END AS currency, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 0.0 END AS rate_25, 0.0 AS rate_5, CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 0.0 END AS rate_105, 1.0 AS rate_21, CASE WHEN l_quantity > 49 THEN 1.0 ELSE 0.0 END AS rate_27, CASE WHEN l_tax > 0.07 THEN l_tax ELSE 0 END AS other_taxes FROM __lineitem__ WHERE l_orderkey % 8 = 0"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SUPPLIERS.replace("__supplier__", "{supplier}"), supplier=read(spark, sf_dir, "supplier"))
    return suppliers.with_aliases(rows.withColumn("aliases", F.array().cast("array<string>")))


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RECEIVED.replace("__lineitem__", "{lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


def q_catalog_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suppliers.import_catalogue(_received(spark, sf_dir))
    return out.select("tax_digits", "legal_name", "document_count", "identifier", "cuit", "other_taxes", F.array_join("document_types", ",").alias("document_types"), F.array_join("currencies", ",").alias("currencies"), F.array_join(F.transform("vat_rates", lambda x: x.cast("string")), ",").alias("vat_rates"))


def q_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers.import_summary(_received(spark, sf_dir), 60)


_BROKEN = f"SELECT concat('p', cast(s_suppkey % 90 AS string)) AS identifier, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE s_name END AS legal_name, CASE WHEN s_suppkey % 13 = 0 THEN '123' ELSE {render.tax_id('s_suppkey')} END AS cuit, s_suppkey % 5 AS document_count FROM __supplier__"


def q_catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_BROKEN.replace("__supplier__", "{supplier}"), supplier=read(spark, sf_dir, "supplier"))
    return suppliers.violations(rows, render.RECEIVER_ID).groupBy("rule").agg(F.count("*").alias("n"))


def q_supplier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suppliers.candidates(_docs(spark, sf_dir), _suppliers(spark, sf_dir), render.RECEIVER_ID)
    return found.select("doc_key", "identifier", "id_hit", "legal_hit", "score")


def q_supplier_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids are hidden in one of three, and whose names in one of five."""
    t = F.when(F.col("doc_key") % 3 == 0, F.regexp_replace("text", "CUIT: [0-9-]+", "CUIT")).otherwise(F.col("text"))
    docs = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_key") % 5 == 0, F.regexp_replace(t, "PROVEEDOR SUPPLIER [0-9]+ SA", "X")).otherwise(t))
    docs = materialised(docs, "hidden")
    found = suppliers.candidates(docs, _suppliers(spark, sf_dir), render.RECEIVER_ID)
    return suppliers.resolve(docs, found)


def q_supplier_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suppliers.candidates(_docs(spark, sf_dir), _suppliers(spark, sf_dir), render.RECEIVER_ID)
    return suppliers.top_candidates(found).select("doc_key", "rank", "identifier", "score")


_HIDE = """CASE WHEN doc_key % 10 = 9 THEN NULL WHEN doc_key % 10 = 8 THEN ' ' WHEN doc_key % 10 = 7 THEN 'Texto sin nada' WHEN doc_key % 10 = 6 THEN replace(text, concat('CUIT: ', supplier_tax_id), 'CUIT') WHEN doc_key % 10 = 5 THEN replace(text, legal_name, 'X') WHEN doc_key % 10 = 4 THEN concat(text, chr(10), 'PROVEEDOR SUPPLIER 000000001 SA') WHEN doc_key % 10 = 3 THEN concat(replace(replace(text, legal_name, 'X'), concat('CUIT: ', supplier_tax_id), 'CUIT'), chr(10), 'PROVEEDOR SUPPLIER 000000001 SA y PROVEEDOR SUPPLIER 000000002 SA') ELSE text END"""


def q_supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their warnings and candidates, of texts with all, some or none of the evidence."""
    docs = render.invoices(spark, sf_dir).select("doc_key", F.expr(_HIDE).alias("text"))
    docs = materialised(docs, "hidden")
    known = _suppliers(spark, sf_dir)
    out = suppliers.results(docs, suppliers.candidates(docs, known, render.RECEIVER_ID, standing=True), known)
    return out.select("doc_key", "detected", "identifier", "legal_name", "method", F.array_join("warnings", " ").alias("warnings"), F.size("candidates").cast("long").alias("n_candidates"), F.coalesce(F.get("candidates", F.lit(0))["score"], F.lit(0)).cast("long").alias("best"))


def q_parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.invoices(spark, sf_dir).select("doc_key", F.expr("CASE doc_key % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', chr(10)) WHEN 2 THEN 'Texto sin nada' ELSE text END").alias("text"))
    return record.parsed(docs).select("doc_key", "successful", "message", "point_of_sale", "sequential_number")


_ODD_VALUES = "SELECT doc_key, CASE doc_key % 5 WHEN 0 THEN letter WHEN 1 THEN 'Z' WHEN 2 THEN '' WHEN 3 THEN lower(letter) END AS letter, CASE doc_key % 7 WHEN 0 THEN issue_date WHEN 1 THEN replace(issue_date, '/', '-') WHEN 2 THEN '2024-1-31' WHEN 3 THEN '31/02/2024' WHEN 4 THEN replace(issue_date, '/', '.') WHEN 5 THEN '' END AS date FROM __facts__"


def q_value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_ODD_VALUES.replace("__facts__", "{facts}"), facts=render.facts(spark, sf_dir))
    return rows.select("doc_key", F.array_join(record.value_errors(F.col("letter"), F.col("date")), "; ").alias("errors"))


def q_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("_011_", "once", 2), ("_00[36]_", "tres_o_seis", 1), ("^3000000000", "chico", 3)], "pattern string, value string, priority int")
    return suppliers.by_rules(render.invoices(spark, sf_dir), rules, F.col("name"))


def q_occasional_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a catalogue that holds the suppliers of even numbers."""
    known = spark.sql(_CATALOGUED.replace("__supplier__", "{supplier}"), supplier=read(spark, sf_dir, "supplier"))
    seen = render.facts(spark, sf_dir).select(F.col("supplier_tax_id").alias("tax_id"), F.col("legal_name").alias("name"), F.concat("document_number", "fiscal_code").alias("document_key"), F.lit("X").alias("folder"), F.col("issued").cast("timestamp").alias("seen_at"))
    out = suppliers.occasional(seen.unionAll(seen.where("tax_id < '30-0000005'")), known)
    return out.select("tax_digits", "name", F.col("occurrences").cast("long"), F.col("first_seen").cast("date"), F.col("last_seen").cast("date"), "review")


_WAYS = "CASE WHEN doc_key % 6 = 5 THEN 'Lista de precios actualizada: presentación, precio sugerido' WHEN doc_key % 6 = 4 THEN ' ' ELSE text END"


def q_process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way, with price lists and blank texts among the documents."""
    docs = _once(render.invoices(spark, sf_dir).select("doc_key", "name", F.expr(_WAYS).alias("text")), "name")
    known = _suppliers(spark, sf_dir).withColumn("folder_name", F.lit(None).cast("string")).withColumn("display_name", F.col("legal_name"))
    return plans.process(docs, known, render.RECEIVER_ID, RECEIVER_NAME).select("doc_key", "status", "fiscal_code", "document_number", "issue_date", "destination")


#: Documents whose names tell a category but whose texts tell nothing, failed ones, and ones that a second
#: reading, a rule for names, a listed issuer or the layout completes.
_PENDING_CASES = f"""SELECT doc_key, kind, letter, document_number, issue_date, fiscal_code, supplier_tax_id, legal_name, house,
  CASE doc_key % 8 WHEN 0 THEN 'CCF_0001.pdf' WHEN 1 THEN 'Transferencia 1.pdf' WHEN 2 THEN 'Lista de precios.pdf' WHEN 4 THEN concat('regla-', cast(s_suppkey AS string), '.pdf') ELSE 'x.pdf' END AS name,
  CASE doc_key % 8 WHEN 0 THEN ' ' WHEN 2 THEN 'Lista de precios actualizada: presentación, precio sugerido' WHEN 3 THEN concat({_TITLE_LINE}, 'CUIT: ', supplier_tax_id, chr(10), 'IVA CAE TOTAL') WHEN 4 THEN concat({_TITLE_LINE}, 'Fecha de Emisión: ', issue_date, chr(10), 'IVA CAE TOTAL')
    WHEN 5 THEN concat('ORIGINAL', chr(10), house, chr(10), 'CUIT: ', other_tax_id, chr(10), {_TITLE_LINE}, 'Fecha de Emisión: ', issue_date, chr(10), 'PUNTO DE VENTA 0001 IVA CAE TOTAL') WHEN 6 THEN concat({_TITLE_LINE}, 'Firma de la casa', chr(10), 'Fecha de Emisión: ', issue_date, chr(10), 'IVA CAE TOTAL')
    WHEN 7 THEN 'Comprobante de transferencia, certificado de retencion' END AS text,
  CASE doc_key % 8 WHEN 0 THEN 'ocr_sin_texto' WHEN 1 THEN 'sin_ocr' END AS read_status, CASE WHEN doc_key % 8 = 2 THEN 'ValueError: roto' END AS error,
  CASE WHEN doc_key % 8 IN (3, 4) THEN concat('Nota de Débito C', chr(10), 'Nro. 00009-00000009', chr(10), 'Fecha de Emisión: ', issue_date, chr(10), 'CAE TOTAL') END AS second_text
FROM (SELECT *, {render.dashed(render.tax_id('(s_suppkey + 5000)'))} AS other_tax_id, concat('ALMACEN K', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' SRL') AS house FROM __facts__) AS f"""


def q_process_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows, texts that are not there, and every way to complete a document."""
    rows = spark.sql(_PENDING_CASES.replace("__facts__", "{facts}"), facts=render.facts(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism))
    supplier = read(spark, sf_dir, "supplier")
    names = supplier.select(F.concat(F.lit("^regla-"), F.col("s_suppkey").cast("string"), F.lit("[.]")).alias("pattern"), F.concat(F.lit("proveedor_"), F.col("s_suppkey").cast("string")).alias("value"), F.col("s_suppkey").alias("priority"))
    listed = spark.createDataFrame([("(?i)firma de la casa", "CASA DE LA FIRMA SA", "30-00000003-1", 1)], "pattern string, legal_name string, tax_id string, priority int")
    known = _suppliers(spark, sf_dir).withColumn("folder_name", F.lit(None).cast("string")).withColumn("display_name", F.col("legal_name"))
    rules = plans.Rules(names=names, issuers=listed)
    second = rows.select("doc_key", F.col("second_text").alias("text")).where("text IS NOT NULL")
    out = plans.process(rows, known, render.RECEIVER_ID, RECEIVER_NAME, second=second, rules=rules)
    return out.select("doc_key", "status", "category", "reason", "fiscal_code", "document_number", "issue_date", "supplier_name", "destination")


# Files --------------------------------------------------------------------------------------------


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.sha2("text", 256).alias("sha256"))


def q_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.exact_duplicates(_hashed(spark, sf_dir)).select("duplicate", "survivor")


def q_dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dedup_plan(_hashed(spark, sf_dir))


def q_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("D/"), F.col("n_regionkey").cast("string"), F.lit(".pdf")).alias("destination"))
    taken = read(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("D/"), F.col("r_regionkey").cast("string"), F.lit(".pdf")).alias("path"))
    return files.free_names(wanted, taken).select("source", "final")


#: Parts go where names with numbers are, some of which are asked for as such.
_ASKED = "SELECT concat('p', lpad(cast(p_partkey AS string), 9, '0')) AS source, CASE WHEN p_partkey % 11 = 0 THEN concat('D/', cast(p_size AS string), '_', cast(2 + p_partkey % 7 AS string), '.pdf') ELSE concat('D/', cast(p_size AS string), '.pdf') END AS destination FROM __part__"
_THERE = "SELECT concat('D/', cast(p_size AS string), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('_', cast(p_partkey % 17 AS string)) END, '.pdf') AS path FROM __part__ WHERE p_partkey % 5 = 0 AND p_size % 2 = 0"


def q_free_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    rows = [spark.sql(q.replace("__part__", "{part}"), part=part) for q in (_ASKED, _THERE)]
    return files.free_names(*rows).select("source", "final")


def q_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents go where half of them are already; some with other content."""
    path = F.concat(F.lit("root/P"), F.col("s_suppkey").cast("string"), F.lit("/01-01"), F.col("fiscal_code"), F.col("document_number"), F.lit("_R_P.pdf"))
    # A table first: the plan reads its two sides in many steps, each of which would join the facts again.
    facts = materialised(render.facts(spark, sf_dir).select("doc_key", path.alias("path")), "paths")
    wanted = facts.select(F.concat(F.lit("_Pendientes/"), F.col("doc_key").cast("string")).alias("source"), F.col("path").alias("destination"), F.col("doc_key").cast("string").alias("sha256"))
    there = facts.where("doc_key % 2 = 0").select("path", F.when(F.col("doc_key") % 4 == 0, F.col("doc_key").cast("string")).otherwise("other").alias("sha256"))
    plan = files.move_plan(wanted, there)
    return plan.groupBy(files.applied(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def q_folder_alias_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    path = F.concat_ws("/", F.concat(F.lit("OLD_"), F.col("n_regionkey").cast("string")), F.concat("n_name", F.lit(".pdf")))
    rows = nation.select(path.alias("path"), F.concat(F.lit("OLD_"), F.col("n_regionkey").cast("string")).alias("folder"), F.concat("n_name", F.lit(".pdf")).alias("name"), F.sha2("n_name", 256).alias("sha256"))
    aliases = read(spark, sf_dir, "region").select(F.concat(F.lit("OLD_"), F.col("r_regionkey").cast("string")).alias("alias"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("canonical"))
    return files.folder_plan(rows, aliases).select(files.applied(F.col("status")).alias("status"), "source", "destination")


def q_new_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".PDF").when(F.col("p_partkey") % 3 == 1, ".txt").otherwise(".bin"))
    rows = part.select(name.alias("name"), F.when(F.col("p_partkey") % 6 == 2, "application/pdf").otherwise("text/plain").alias("mime"))
    return files.new_attachments(rows, part.where("p_size > 25").select(name.alias("name"))).select("name", "status")


def q_sender_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    sender = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"Cliente: '), F.col("o_custkey").cast("string"), F.lit('" <a@b.example>'))).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@b.example")))
    return orders.select("o_orderkey", files.sender_folder(sender, F.col("o_orderdate")).alias("folder"))


# State --------------------------------------------------------------------------------------------

_ATTEMPTS = "SELECT cast(user_id AS string) AS source_key, event_id AS attempt_no, ts AS attempted_at, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'ok' END AS outcome, cast(event_id % 3 AS int) AS pdf_count, concat('E', cast(event_id % 10 AS string)) AS error FROM __events__"
_STATE = f"""SELECT source_key, max_by(status, (attempted_at, attempt_no)) AS status, count(*) AS attempts, max_by(pdf_count, (attempted_at, attempt_no)) AS pdf_count,
  min(attempted_at) AS first_seen, max(attempted_at) AS last_attempt, max_by(coalesce(CASE WHEN status = 'error' THEN error END, '-'), (attempted_at, attempt_no)) AS last_error
  FROM (SELECT *, CASE WHEN outcome = 'error' THEN 'error' WHEN pdf_count > 0 THEN 'processed' ELSE 'no_pdf' END AS status FROM ({_ATTEMPTS.replace('__events__', 'events')})) GROUP BY 1"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fold(spark.sql(_ATTEMPTS.replace("__events__", "{events}"), events=read(spark, sf_dir, "events")))


def q_history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("source_key", "status", "attempts", F.col("pdf_count").cast("int"), F.coalesce("last_error", F.lit("-")).alias("last_error"), F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_attempt").alias("last_attempt"))


def q_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary(_state(spark, sf_dir))


def q_history_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.errors(_state(spark, sf_dir)).select("source_key", "attempts", "last_error")


def q_incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_key"), F.col("c_custkey").alias("sequence"))
    return history.pending(messages, _state(spark, sf_dir))


def q_recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_key"), F.col("c_custkey").alias("sequence"))
    return history.pending(messages, _state(spark, sf_dir), 10)


def q_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    gmail = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(" ")
    message = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("<"), F.col("event_type"), F.lit(">")))
    return events.select("event_id", history.source_key(gmail, message, F.col("user_id")).alias("source_key"))


def q_final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    nth = lambda n: F.col("event_id") % n == 0
    found = events.select(nth(3).alias("saved"), (~nth(3)).alias("existed"))
    readings = events.select(F.when(~nth(5), nth(2) | nth(7)).alias("ok"), nth(2).alias("has_text"))
    detections = events.select(nth(2).alias("done"), F.when(nth(4), nth(3)).alias("detected"), F.when(nth(11), "E").alias("error"))
    return run.final_summary(found, readings, detections)


def q_rescue_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_DROPPED.replace("__facts__", "{facts}"), facts=render.facts(spark, sf_dir))
    needs = run.needs_rescue(F.col("doc_key") % 4 != 1, {f: F.col(f) for f in run.CRITICAL})
    return rows.select("doc_key", needs.alias("needs_rescue"))


def q_name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for names first, then ids in the names of files."""
    rules = spark.createDataFrame([("^7-", "siete", 1)], "pattern string, value string, priority int")
    docs = render.facts(spark, sf_dir).select("doc_key", F.concat(F.col("doc_key").cast("string"), F.lit("-"), F.when(F.col("doc_key") % 3 == 0, taxid.digits(F.col("supplier_tax_id"))).otherwise(F.col("supplier_tax_id")), F.lit("_x.pdf")).alias("name"))
    return suppliers.by_name(docs, rules, _suppliers(spark, sf_dir), render.RECEIVER_ID, F.col("name"))


def q_catalog_reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that finds half of its suppliers in an earlier catalogue, by name or alias."""
    first = suppliers.import_catalogue(_received(spark, sf_dir)).where("substr(tax_digits, 10, 1) < '5'")
    before = first.select(F.concat(F.lit("viejo_"), "tax_digits").alias("identifier"), F.when(F.substring("tax_digits", 9, 1) < "5", F.col("legal_name")).otherwise("Otro").alias("legal_name"), F.lit(None).cast("string").alias("display_name"), F.lit("Carpeta").alias("folder_name"), F.array(F.upper("legal_name")).alias("aliases"))
    out = suppliers.import_catalogue(_received(spark, sf_dir), previous=before)
    return out.select("tax_digits", "identifier", "folder_name")


def q_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


# Oracle -------------------------------------------------------------------------------------------


def _tr(c: str) -> str:
    return f"translate(replace({c}, 'ß', 'ss'), '{UPPER_FROM}', '{UPPER_TO}')"


def _key(c: str) -> str:
    return f"trim(regexp_replace(upper({_tr(c)}), '[^A-Z0-9]+', ' ', 'g'))"


def _token(c: str) -> str:
    return f"CASE WHEN {_key(c)} = '' THEN 'SIN_DATO' ELSE replace({_key(c)}, ' ', '_') END"


_CENTS = render.cents_text("cents")
_VAT = f"CASE WHEN doc_key % 2 = 0 THEN {render.cents_text(render.VAT_21)} ELSE {render.cents_text(render.VAT_10)} END"
_SHOWN_RECEIVER = "'30-71111111-1'"
_FOLD = f"({_STATE})"
_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_CATALOGUE = _SUPPLIERS.replace("__supplier__", "supplier")
_MATCH = f"""SELECT doc_key, identifier, contains(d, cuit) AS id_hit, contains(t, legal_name) OR (contains(t, bare)) AS legal_hit
  FROM (SELECT doc_key, {_DIGITS} AS d, {_key('text')} AS t FROM (__docs__)), (SELECT *, substr(legal_name, 1, length(legal_name) - 3) AS bare FROM ({_CATALOGUE}))
  WHERE contains(d, cuit) OR contains(t, legal_name) OR contains(t, bare)"""
_SCORED = f"SELECT doc_key, identifier, id_hit, legal_hit, CASE WHEN id_hit AND legal_hit THEN 11 WHEN id_hit THEN 6 ELSE 3 END AS score FROM ({_MATCH})"
_HIDDEN = "SELECT doc_key, CASE WHEN doc_key % 5 = 0 THEN replace(t, legal_name, 'X') ELSE t END AS text FROM (SELECT doc_key, legal_name, CASE WHEN doc_key % 3 = 0 THEN replace(text, concat('CUIT: ', supplier_tax_id), 'CUIT') ELSE text END AS t FROM (" + INVOICES + "))"
_RECEIVED_SQL = _RECEIVED.replace("__lineitem__", "lineitem")
_HASHED = "SELECT concat(source, '/', lpad(cast(doc_id AS string), 9, '0')) AS path, sha256(text) AS h FROM documents"
_DUPLICATES = f"SELECT path AS duplicate, survivor FROM (SELECT path, first_value(path) OVER (PARTITION BY h ORDER BY lower(path), path) AS survivor FROM ({_HASHED})) WHERE path <> survivor"
_PENDING = "NOT EXISTS (SELECT 1 FROM " + _FOLD + " AS s WHERE s.source_key = m.source_key AND s.status IN ('processed', 'no_pdf'))"
_MESSAGES = "SELECT cast(c_custkey AS string) AS source_key, c_custkey AS sequence FROM customer"

SQL = {
    "q_render_invoices": f"SELECT doc_key, name, cast(length(text) AS bigint) AS n_chars, sha256(text) AS text_sha256 FROM ({INVOICES})",
    "q_header_extract": f"SELECT doc_key, kind AS document_type, letter AS fiscal_letter, document_number, issue_date, fiscal_code, true AS supported, cast(0 AS bigint) AS n_warnings FROM ({FACTS})",
    "q_fiscal_code_counts": f"SELECT fiscal_code, count(*) AS n_docs, cast(sum(total) AS decimal(28,2)) AS total FROM ({FACTS}) GROUP BY 1",
    "q_amounts": f"SELECT doc_key, {_CENTS} AS subtotal, {_VAT} AS taxes, {_CENTS} AS total_amount, total AS total_dec FROM ({FACTS})",
    "q_currency_cae": f"SELECT doc_key, CASE WHEN doc_key % 5 = 0 THEN 'USD' ELSE 'ARS' END AS currency, concat('7', lpad(cast(doc_key AS string), 13, '0')) AS cae, issue_date AS cae_expiration, supplier_tax_id AS issuer_tax_id, {_SHOWN_RECEIVER} AS receiver_tax_id FROM ({FACTS})",
    "q_tax_id_extract": f"SELECT doc_key, concat(supplier_tax_id, ',', {_SHOWN_RECEIVER}) AS ids FROM ({FACTS})",
    "q_tax_profile": f"SELECT supplier_tax_id, min(legal_name) AS supplier_name, false AS vat_27, bool_or(doc_key % 2 = 0) AS vat_21, bool_or(doc_key % 2 = 1) AS vat_10_5, false AS vat_perception, bool_or(doc_key % 7 = 0) AS iibb_caba_perception, false AS iibb_bsas_perception, bool_or(doc_key % 11 = 0) AS internal_taxes, count(*) AS invoices_analyzed FROM ({FACTS}) GROUP BY 1",
    "q_issuer_identity": f"SELECT doc_key, supplier_tax_id AS tax_id, legal_name AS name FROM ({FACTS})",
    "q_issuer_layouts": f"SELECT doc_key, supplier_tax_id AS tax_id, issuer AS name, score FROM ({render.issuer_pages_sql()}) WHERE issuer IS NOT NULL",
    "q_evidence_fusion": f"SELECT doc_key, kind AS document_type, letter AS fiscal_letter, document_number FROM ({FACTS})",
    "q_reading_fusion": f"""SELECT doc_key, CASE doc_key % 4 WHEN 0 THEN 'fusion_ocr[psm_3+psm_6]' WHEN 3 THEN 'sin_ocr' ELSE 'psm_3' END AS method, CASE WHEN doc_key % 4 < 3 THEN kind END AS document_type, CASE WHEN doc_key % 4 < 3 THEN letter END AS fiscal_letter,
CASE WHEN doc_key % 4 < 3 THEN document_number END AS document_number, CASE WHEN doc_key % 4 < 3 THEN issue_date END AS issue_date,
sha256(CASE doc_key % 4 WHEN 0 THEN concat(trim(a), chr(10), chr(10), 'RAZON SOCIAL: ', house, chr(10), 'CUIT EMISOR: ', supplier_tax_id, chr(10), 'FECHA DE EMISION: ', issue_date) WHEN 3 THEN '' ELSE a END) AS text_sha256 FROM ({_READ.replace('__facts__', '(' + FACTS + ')')})""",
    "q_filename_evidence": f"SELECT doc_key, {_case([e[0] for e in _EXPECTED])} AS document_type, {_case([e[1] for e in _EXPECTED])} AS fiscal_letter, CASE WHEN doc_key % 14 < 13 THEN document_number END AS document_number, {_case([e[2] for e in _EXPECTED])} AS method FROM ({FACTS})",
    "q_name_fusion": f"SELECT doc_key, kind AS document_type, letter AS fiscal_letter, document_number FROM ({FACTS})",
    "q_canonical_name": f"SELECT doc_key, concat(replace(legal_name, ' ', '_'), '/', substr(issue_date, 7, 4), '/', substr(issue_date, 4, 2)) AS folder, concat(substr(issue_date, 1, 2), '-', substr(issue_date, 4, 2), fiscal_code, document_number, '_RECEPTORA_', replace(legal_name, ' ', '_'), '.pdf') AS file_name, concat(fiscal_code, ':', replace(document_number, '-', ':')) AS fiscal_key FROM ({FACTS})",
    "q_date_audit": f"WITH a AS ({_AUDITED.replace('__facts__', FACTS)}) SELECT CASE WHEN issue_date IS NULL THEN 'error' ELSE 'would_move' END AS status, path AS source, CASE WHEN issue_date IS NOT NULL THEN target END AS destination, CASE WHEN issue_date IS NULL THEN 'sin fecha' ELSE '' END AS detail FROM a WHERE issue_date IS NULL OR path <> target",
    "q_norm_search": f"SELECT doc_id, sha256({_key('text')}) AS key_sha256, sha256(trim(regexp_replace(translate(upper({_tr('text')}), '°', 'O'), '\\s+', ' ', 'g'))) AS upper_sha256 FROM documents",
    "q_clean_lines": "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS lines_sha256 FROM documents",
    "q_path_token": f"SELECT conv_id, turn, {_token('text')} AS token FROM conversations",
    "q_text_preview": "SELECT doc_id, CASE WHEN length(trim(text)) > 500 THEN concat(rtrim(substr(trim(text), 1, 500)), chr(10), '[...]') ELSE trim(text) END AS preview FROM documents",
    "q_page_join": "SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN turn % 3 <> 2 AND trim(text) <> '' THEN trim(text) END, concat(chr(10), chr(10)) ORDER BY turn), '')) AS text_sha256, count(*) AS n_pages, count(CASE WHEN turn % 3 <> 2 AND trim(text) <> '' THEN 1 END) AS n_text_pages, count(CASE WHEN turn % 3 <> 2 AND trim(text) <> '' THEN 1 END) > 0 AS has_text FROM conversations GROUP BY 1",
    "q_tax_id_valid": f"SELECT s_suppkey, s_suppkey % 3 <> 0 AS valid, {render.dashed('d')} AS shown, CASE WHEN s_suppkey % 3 <> 0 THEN {render.dashed('d')} END AS shown_valid FROM ({_IDS.replace('__supplier__', 'supplier')})",
    "q_missing_fields": f"SELECT doc_key, CASE WHEN m <> '' THEN concat('Faltan: ', m) END AS pending_reason FROM (SELECT doc_key, concat_ws(', ', CASE WHEN issue_date IS NULL THEN 'fecha' END, CASE WHEN document_type IS NULL THEN 'tipo' END, CASE WHEN fiscal_letter IS NULL THEN 'letra' END, CASE WHEN document_number = '' THEN 'numero' END, CASE WHEN supplier_name IS NULL THEN 'proveedor' END) AS m FROM ({_DROPPED.replace('__facts__', '(' + FACTS + ')')}))",
    "q_classify_decision": f"SELECT doc_key, CASE doc_key % 7 {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(_CLASSES))} END AS category, CASE WHEN doc_key % 7 = 6 THEN 'ninguna' ELSE 'alta' END AS confidence FROM ({FACTS})",
    "q_classify_counts": f"SELECT CASE doc_key % 7 {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(_CLASSES))} END AS category, count(*) AS n FROM ({FACTS}) GROUP BY 1",
    "q_catalog_import": f"""WITH r AS ({_RECEIVED_SQL}), n AS (SELECT tax_id, name, count(*) AS c, min(row_no) AS seen FROM r GROUP BY 1, 2),
m AS (SELECT tax_id, name, sum(c) OVER (PARTITION BY tax_id) AS total, row_number() OVER (PARTITION BY tax_id ORDER BY c DESC, seen) AS k FROM n),
g AS (SELECT tax_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS document_types, string_agg(DISTINCT CASE WHEN currency = '$' THEN 'ARS' ELSE 'USD' END, ',' ORDER BY CASE WHEN currency = '$' THEN 'ARS' ELSE 'USD' END) AS currencies, bool_or(other_taxes <> 0) AS other_taxes,
  concat_ws(',', CASE WHEN bool_or(rate_25 <> 0) THEN '2.5' END, CASE WHEN bool_or(rate_105 <> 0) THEN '10.5' END, CASE WHEN bool_or(rate_21 <> 0) THEN '21.0' END, CASE WHEN bool_or(rate_27 <> 0) THEN '27.0' END) AS vat_rates FROM r GROUP BY 1),
s AS (SELECT tax_id, name, total, lower(replace(name, ' ', '_')) AS slug FROM m WHERE k = 1 AND total >= 2)
SELECT tax_id AS tax_digits, name AS legal_name, cast(total AS bigint) AS document_count, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY total DESC, name, tax_id) > 1 THEN concat(slug, '_', substr(tax_id, 8, 4)) ELSE slug END AS identifier, {render.dashed('tax_id')} AS cuit, other_taxes, document_types, currencies, vat_rates FROM s JOIN g USING (tax_id)""",
    "q_catalog_summary": f"SELECT cast(coalesce(sum(n), 0) AS bigint) AS source_rows, count(*) AS unique_emitters, count(CASE WHEN n >= 60 THEN 1 END) AS included, count(CASE WHEN n < 60 THEN 1 END) AS excluded FROM (SELECT tax_id, count(*) AS n FROM ({_RECEIVED_SQL}) GROUP BY 1)",
    "q_catalog_violations": f"""WITH b AS ({_BROKEN.replace('__supplier__', 'supplier')}), u AS (SELECT 'identificador duplicado' AS rule FROM (SELECT count(*) OVER (PARTITION BY identifier) AS n FROM b) WHERE n > 1
UNION ALL SELECT 'cuit duplicado' FROM (SELECT count(*) OVER (PARTITION BY cuit) AS n FROM b) WHERE n > 1 UNION ALL SELECT 'sin razon social' FROM b WHERE trim(legal_name) = '' UNION ALL SELECT 'cuit sin once digitos' FROM b WHERE length(cuit) <> 11 UNION ALL SELECT 'menos de dos documentos' FROM b WHERE document_count < 2)
SELECT rule, count(*) AS n FROM u GROUP BY 1""",
    "q_supplier_candidates": f"SELECT doc_key, identifier, id_hit, legal_hit, score FROM ({_SCORED.replace('__docs__', INVOICES)})",
    "q_supplier_top5": f"SELECT doc_key, cast(k AS int) AS rank, identifier, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, id_hit DESC, legal_hit DESC, identifier DESC) AS k FROM ({_SCORED.replace('__docs__', INVOICES)})) WHERE k <= 5",
    "q_supplier_resolve": f"""WITH c AS ({_SCORED.replace('__docs__', _HIDDEN)}), g AS (SELECT doc_key, max(score) AS best, count(*) FILTER (WHERE score = m) AS ties, bool_or(id_hit) AND bool_or(legal_hit) AND NOT bool_or(id_hit AND legal_hit) AS against, max_by(identifier, (score, id_hit, legal_hit, identifier)) AS identifier, max_by(id_hit, (score, id_hit, legal_hit, identifier)) AS i, max_by(legal_hit, (score, id_hit, legal_hit, identifier)) AS l FROM (SELECT *, max(score) OVER (PARTITION BY doc_key) AS m FROM c) GROUP BY 1)
SELECT f.doc_key, best IS NOT NULL AND NOT against AND ties = 1 AS detected, CASE WHEN NOT against AND ties = 1 THEN identifier END AS identifier,
CASE WHEN best IS NULL THEN 'sin_coincidencias' WHEN against THEN 'evidencia_contradictoria' WHEN ties > 1 THEN 'candidatos_empatados' WHEN i AND l THEN 'razon_social_y_cuit' WHEN i THEN 'cuit' ELSE 'razon_social' END AS method,
CASE WHEN best IS NULL OR against OR ties > 1 THEN 'ninguna' WHEN i AND l THEN 'alta' ELSE 'media' END AS confidence, coalesce(best, 0) AS score FROM ({FACTS}) AS f LEFT JOIN g ON f.doc_key = g.doc_key""",
    "q_process_documents": f"""SELECT doc_key, CASE doc_key % 6 WHEN 5 THEN 'archivado' WHEN 4 THEN 'pendiente' ELSE 'organizado' END AS status, fiscal_code, document_number, CASE WHEN doc_key % 6 < 4 THEN issue_date END AS issue_date,
CASE doc_key % 6 WHEN 5 THEN concat('_Listas_De_Precios/', name) WHEN 4 THEN concat('_Pendientes/', name) ELSE concat(replace(legal_name, ' ', '_'), '/', substr(issue_date, 7, 4), '/', substr(issue_date, 4, 2), '/', substr(issue_date, 1, 2), '-', substr(issue_date, 4, 2), fiscal_code, document_number, '_RECEPTORA_DE_PRUEBA_', replace(legal_name, ' ', '_'), '.pdf') END AS destination FROM ({INVOICES})""",
    "q_process_pending": f"""SELECT doc_key, CASE WHEN r < 2 THEN 'pendiente' WHEN r = 2 THEN 'error' WHEN r = 7 THEN 'archivado' ELSE 'organizado' END AS status, CASE WHEN r < 2 THEN 'desconocido' WHEN r = 2 THEN 'error' WHEN r = 7 THEN 'retenciones_transferencias' ELSE 'factura' END AS category,
CASE r WHEN 0 THEN 'el OCR no halló texto' WHEN 1 THEN 'no hay motor de OCR' WHEN 2 THEN 'ValueError: roto' WHEN 7 THEN 'categoría prioritaria' END AS reason, CASE WHEN r BETWEEN 3 AND 6 THEN fiscal_code END AS fiscal_code, CASE WHEN r BETWEEN 3 AND 6 THEN document_number END AS document_number,
CASE WHEN r BETWEEN 3 AND 6 THEN issue_date END AS issue_date, s AS supplier_name, CASE WHEN r < 2 THEN concat('_Pendientes/', name) WHEN r = 7 THEN '_Retenciones_Transferencias/x.pdf' WHEN r BETWEEN 3 AND 6 THEN concat(replace(s, ' ', '_'), '/', substr(issue_date, 7, 4), '/', substr(issue_date, 4, 2), '/', substr(issue_date, 1, 2), '-', substr(issue_date, 4, 2), fiscal_code, document_number, '_RECEPTORA_DE_PRUEBA_', replace(s, ' ', '_'), '.pdf') END AS destination
FROM (SELECT *, doc_key % 8 AS r, CASE WHEN doc_key % 8 IN (3, 4) THEN legal_name WHEN doc_key % 8 = 5 THEN house WHEN doc_key % 8 = 6 THEN 'CASA DE LA FIRMA SA' END AS s FROM ({_PENDING_CASES.replace('__facts__', '(' + FACTS + ')')}))""",
    "q_name_rules": f"SELECT doc_key, CASE WHEN name LIKE '%\\_003\\_%' ESCAPE '\\' OR name LIKE '%\\_006\\_%' ESCAPE '\\' THEN 'tres_o_seis' WHEN name LIKE '%\\_011\\_%' ESCAPE '\\' THEN 'once' ELSE 'chico' END AS value FROM ({INVOICES}) WHERE name LIKE '%\\_003\\_%' ESCAPE '\\' OR name LIKE '%\\_006\\_%' ESCAPE '\\' OR name LIKE '%\\_011\\_%' ESCAPE '\\' OR name LIKE '3000000000%'",
    "q_occasional_candidates": f"SELECT tax_digits, min(legal_name) AS name, count(DISTINCT concat(document_number, fiscal_code)) AS occurrences, min(issued) AS first_seen, max(issued) AS last_seen, count(DISTINCT concat(document_number, fiscal_code)) >= 3 AS review FROM ({FACTS}) WHERE s_suppkey % 2 = 1 GROUP BY 1",
    "q_exact_duplicates": _DUPLICATES,
    "q_dedup_plan": f"SELECT 'would_remove' AS status, duplicate AS source, survivor AS destination, 'identical content' AS detail FROM ({_DUPLICATES})",
    "q_destinations": "SELECT n_name AS source, CASE WHEN k + b = 1 THEN concat('D/', cast(n_regionkey AS string), '.pdf') ELSE concat('D/', cast(n_regionkey AS string), '_', cast(k + b AS string), '.pdf') END AS final FROM (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k, CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 0 END AS b FROM nation)",
    "q_free_numbers": f"""WITH a AS ({_ASKED.replace('__part__', 'part')}), t AS (SELECT DISTINCT path FROM ({_THERE.replace('__part__', 'part')})), o AS (SELECT path FROM t UNION SELECT destination FROM a),
w AS (SELECT source, destination, row_number() OVER (PARTITION BY destination ORDER BY source) - CASE WHEN path IS NULL THEN 1 ELSE 0 END AS k FROM a LEFT JOIN t ON path = destination),
f AS (SELECT destination, n, row_number() OVER (PARTITION BY destination ORDER BY n) AS k FROM (SELECT destination, unnest(generate_series(2, max(k) + 30)) AS n FROM w WHERE k > 0 GROUP BY destination) AS g
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE path = concat(substr(destination, 1, length(destination) - 4), '_', cast(n AS string), '.pdf')))
SELECT source, CASE WHEN k = 0 THEN destination ELSE concat(substr(destination, 1, length(destination) - 4), '_', cast(n AS string), '.pdf') END AS final FROM w LEFT JOIN f USING (destination, k)""",
    "q_move_plan": f"SELECT CASE WHEN doc_key % 4 = 0 THEN 'duplicate_removed' WHEN doc_key % 2 = 0 THEN 'fiscal_conflict' ELSE 'moved' END AS status, count(*) AS n FROM ({FACTS}) GROUP BY 1",
    "q_folder_alias_plan": "SELECT 'movido' AS status, concat('OLD_', cast(n_regionkey AS string), '/', n_name, '.pdf') AS source, concat(replace(r_name, ' ', '_'), '/', n_name, '.pdf') AS destination FROM nation JOIN region ON n_regionkey = r_regionkey",
    "q_new_attachments": "WITH p AS (SELECT p_partkey, p_size, concat(cast(p_partkey AS string), CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.bin' END) AS name FROM part) SELECT name, CASE WHEN p_size > 25 THEN 'ya_existia' ELSE 'guardado' END AS status FROM p WHERE p_partkey % 3 = 0 OR p_partkey % 6 = 2",
    "q_sender_folder": "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN concat('Cliente- ', cast(o_custkey AS string)) ELSE concat('c', cast(o_custkey AS string)) END, '/', cast(extract(year FROM o_orderdate) AS string), '/', lpad(cast(extract(month FROM o_orderdate) AS string), 2, '0'), ' - ', ['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre'][extract(month FROM o_orderdate)]) AS folder FROM orders",
    "q_history_fold": f"SELECT source_key, status, attempts, pdf_count, last_error, cast(floor(epoch(first_seen)) AS bigint) AS first_seen, cast(floor(epoch(last_attempt)) AS bigint) AS last_attempt FROM {_FOLD}",
    "q_history_summary": f"SELECT count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'no_pdf') AS no_pdf, count(*) FILTER (WHERE status = 'error') AS error, count(*) AS total FROM {_FOLD}",
    "q_history_errors": f"SELECT source_key, attempts, last_error FROM {_FOLD} WHERE status = 'error'",
    "q_state_counts": f"SELECT status, count(*) AS n FROM {_FOLD} GROUP BY 1",
    "q_incremental_antijoin": f"SELECT source_key, sequence FROM ({_MESSAGES}) AS m WHERE {_PENDING}",
    "q_recent_n": f"SELECT source_key, sequence FROM (SELECT * FROM ({_MESSAGES}) ORDER BY sequence DESC LIMIT 10) AS m WHERE {_PENDING}",
    "q_source_keys": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('gmail:', cast(event_id AS string)) WHEN 1 THEN concat('message-id:<', event_type, '>') ELSE concat('imap-sequence:', cast(user_id AS string)) END AS source_key FROM events",
    "q_final_summary": """SELECT count(*) AS pdf_found, count(*) FILTER (WHERE event_id % 3 = 0) AS pdf_new, count(*) FILTER (WHERE event_id % 3 <> 0) AS pdf_existing,
count(*) FILTER (WHERE ok) AS read_ok, count(*) FILTER (WHERE ok AND event_id % 2 = 0) AS with_text, count(*) FILTER (WHERE ok AND event_id % 2 <> 0) AS without_text, count(*) FILTER (WHERE NOT ok) AS read_errors,
count(*) FILTER (WHERE event_id % 2 = 0) AS detections, count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 12 = 0) AS suppliers_found, count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 12 <> 0) AS suppliers_missing,
count(*) FILTER (WHERE event_id % 2 <> 0) AS not_detected, count(*) FILTER (WHERE event_id % 11 = 0) AS detection_errors FROM (SELECT *, event_id % 5 <> 0 AND (event_id % 2 = 0 OR event_id % 7 = 0) AS ok FROM events)""",
    "q_rescue_needed": f"SELECT doc_key, doc_key % 4 = 1 OR doc_key % 2 <> 0 OR doc_key % 3 <> 0 OR doc_key % 5 = 0 OR doc_key % 7 = 0 AS needs_rescue FROM ({FACTS})",
    "q_name_ids": f"SELECT doc_key, CASE WHEN doc_key = 7 THEN 'siete' ELSE concat('proveedor_', cast(s_suppkey AS string)) END AS identifier FROM ({FACTS}) WHERE doc_key = 7 OR doc_key % 3 = 0",
}
SQL["q_catalog_reimport"] = f"""WITH f AS ({SQL['q_catalog_import']}), p AS (SELECT upper(replace(legal_name, ' ', '')) AS k, min(concat('viejo_', tax_digits)) AS old FROM f WHERE substr(tax_digits, 10, 1) < '5' GROUP BY 1),
b AS (SELECT tax_digits, legal_name, document_count, old, coalesce(old, lower(replace(legal_name, ' ', '_'))) AS base FROM f LEFT JOIN p ON upper(replace(legal_name, ' ', '')) = k)
SELECT tax_digits, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY document_count DESC, legal_name, tax_digits) > 1 THEN concat(base, '_', substr(tax_digits, 8, 4)) ELSE base END AS identifier, CASE WHEN old IS NOT NULL THEN 'Carpeta' END AS folder_name FROM b"""
_TOLD = {m: " ".join(w) for m, w in suppliers.WARNINGS.items()}
SQL["q_supplier_results"] = f"""WITH d AS (SELECT doc_key, s_suppkey, legal_name, {_HIDE} AS text FROM ({INVOICES})), r AS (SELECT doc_key, s_suppkey, legal_name, doc_key % 10 AS r FROM d),
m AS (SELECT *, CASE WHEN r = 9 THEN 'texto_ausente' WHEN r = 8 THEN 'texto_vacio' WHEN r = 7 THEN 'sin_coincidencias' WHEN r = 6 THEN 'razon_social' WHEN r = 5 THEN 'cuit' WHEN r = 3 THEN 'candidatos_empatados' ELSE 'razon_social_y_cuit' END AS method FROM r)
SELECT doc_key, r NOT IN (3, 7, 8, 9) AS detected, CASE WHEN r NOT IN (3, 7, 8, 9) THEN concat('proveedor_', cast(s_suppkey AS string)) END AS identifier, CASE WHEN r NOT IN (3, 7, 8, 9) THEN legal_name END AS legal_name, method,
CASE method {' '.join(f"WHEN '{m}' THEN '{t}'" for m, t in _TOLD.items())} ELSE '' END AS warnings,
cast(CASE WHEN r > 6 THEN 0 WHEN r = 3 THEN 2 WHEN r = 4 AND s_suppkey <> 1 THEN 2 ELSE 1 END AS bigint) AS n_candidates, cast(CASE WHEN r > 6 THEN 0 WHEN r IN (3, 6) THEN 3 WHEN r = 5 THEN 6 ELSE 11 END AS bigint) AS best FROM m"""
SQL["q_parsed_documents"] = f"""SELECT doc_key, doc_key % 5 > 1 AS successful, CASE doc_key % 5 WHEN 0 THEN 'El valor recibido no es una cadena de caracteres.' WHEN 1 THEN 'No se recibió texto válido para analizar.' WHEN 2 THEN 'Análisis completado. Se detectaron 1 datos.' ELSE 'Análisis completado. Se detectaron 12 datos.' END AS message,
CASE WHEN doc_key % 5 > 2 THEN lpad(cast(point AS string), 5, '0') END AS point_of_sale, CASE WHEN doc_key % 5 > 2 THEN lpad(cast(number_ AS string), 8, '0') END AS sequential_number FROM ({FACTS})"""
SQL["q_value_errors"] = f"SELECT doc_key, concat_ws('; ', CASE WHEN letter = 'Z' THEN 'Letra fiscal no admitida: ''Z''' END, CASE WHEN doc_key % 7 IN (3, 4) THEN concat('Fecha de emisión inválida: ''', date, '''') END) AS errors FROM ({_ODD_VALUES.replace('__facts__', '(' + FACTS + ')')})"
SQL["q_tax_profile_resolved"] = f"SELECT p.*, s.by_layout FROM ({SQL['q_tax_profile']}) AS p JOIN (SELECT supplier_tax_id, bool_and(s_suppkey % 2 = 1) AS by_layout FROM ({FACTS}) GROUP BY 1) AS s USING (supplier_tax_id)"
SQL["q_tax_profile_export"] = "SELECT supplier_name, supplier_tax_id, " + ", ".join(f"CASE WHEN {c} THEN 'Sí' ELSE 'No' END AS {c}" for c in amounts.TAXES) + f" FROM ({SQL['q_tax_profile']})"


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
