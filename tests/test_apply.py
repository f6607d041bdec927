"""Plans that are applied, imports, settings, and matching of suppliers by name."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fiscora import __main__ as command
from fiscora import config
from fiscora.operators import files, run, suppliers
from fiscora.sources import apply
from fiscora.streaming import history


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content)


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def ask(spark, *given):
    return sorted(tuple(r) for r in command.run(spark, command.arguments(list(given))).collect())


def test_deduplicate(spark, tmp_path):
    root = tmp_path / "r"
    for path, content in (("A/x.pdf", b"1"), ("B/x.pdf", b"1"), ("B/y.pdf", b"2"), ("_Pendientes/x.pdf", b"1")):
        put(root, path, content)
    before = tree(root)
    shown = [("would_remove", "B/x.pdf", "A/x.pdf", "identical content")]
    assert ask(spark, "deduplicate", "--root", str(root)) == shown and tree(root) == before
    assert ask(spark, "deduplicate", "--root", str(root), "--apply") == [("duplicate_removed", "B/x.pdf", "A/x.pdf", "")]
    assert tree(root) == {k: v for k, v in before.items() if k != "B/x.pdf"}
    assert ask(spark, "deduplicate", "--root", str(root), "--apply") == []


def test_moves_are_done_once_and_never_overwrite(spark, tmp_path):
    for path, content in (("in/a", b"a"), ("in/b", b"b"), ("in/c", b"c"), ("out/b", b"other"), ("out/c", b"c")):
        put(tmp_path, path, content)
    plan = spark.createDataFrame([("would_moved", "in/a", "out/d/a"), ("would_moved", "in/b", "out/b"), ("would_duplicate_removed", "in/c", "out/c"), ("would_moved", "in/none", "out/none"), ("conflict", "in/b", "out/b"), ("would_duplicate_removed", "out/b", "out/c")], "status string, source string, destination string")
    for _ in range(2):  # a repeated task changes nothing more
        found = {(r["source"], r["destination"]): r["status"] for r in apply.apply_plan(plan.where("status <> 'conflict'"), str(tmp_path)).collect()}
        assert found == {("in/a", "out/d/a"): "moved", ("in/b", "out/b"): "error", ("in/c", "out/c"): "duplicate_removed", ("in/none", "out/none"): "error", ("out/b", "out/c"): "error"}
        assert tree(tmp_path) == {"out/d/a": b"a", "in/b": b"b", "out/b": b"other", "out/c": b"c"}


def test_folders_and_dates(spark, tmp_path):
    root = tmp_path / "r"
    for path, content in (("OLD/x.pdf", b"1"), ("OLD/y.pdf", b"2"), ("NEW/x.pdf", b"1"), ("NEW/y.pdf", b"3")):
        put(root, path, content)
    spark.createDataFrame([("OLD", "NEW")], "alias string, canonical string").write.parquet(f"{tmp_path}/aliases")
    assert {r[0] for r in ask(spark, "normalize-folders", "--root", str(root), "--table", f"{tmp_path}/aliases")} == {"previsto_duplicado_eliminado", "previsto_movido_con_sufijo"}
    assert {r[0] for r in ask(spark, "normalize-folders", "--root", str(root), "--table", f"{tmp_path}/aliases", "--apply")} == {"duplicado_eliminado", "movido_con_sufijo"}
    assert tree(root) == {"NEW/x.pdf": b"1", "NEW/y.pdf": b"3", "NEW/y_2.pdf": b"2"} and not (root / "OLD").exists()


def test_attachments_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", "x", bytearray(b"%PDF")), ("b.txt", "application/pdf", bytearray(b"2")), ("c.pdf", "x", bytearray(b"3"))], "name string, mime string, content binary")
    there = spark.createDataFrame([("c.pdf",)], "name string")
    plan = files.new_attachments(rows, there).withColumn("destination", F.concat(F.lit("in/"), F.col("name")))
    assert {r["destination"]: r["status"] for r in apply.write_files(plan, str(tmp_path)).collect()} == {"in/a.pdf": "guardado", "in/b.txt": "guardado", "in/c.pdf": "ya_existia"}
    assert tree(tmp_path) == {"in/a.pdf": b"%PDF", "in/b.txt": b"2"}


def test_history_reset_and_merge(spark, tmp_path):
    log = spark.sql("SELECT cast(id % 7 AS string) AS source_key, id AS attempt_no, timestamp_seconds(id * 60) AS attempted_at, CASE WHEN id % 4 = 0 THEN 'error' ELSE 'ok' END AS outcome, cast(id % 3 AS int) AS pdf_count, 'E' AS error FROM range(50)")
    whole = history.fold(log)
    parts = history.merge(history.fold(log.where("id % 3 = 0" if "id" in log.columns else "attempt_no % 3 = 0")), history.fold(log.where("attempt_no % 3 <> 0")))
    assert sorted(whole.collect()) == sorted(parts.collect())
    whole.write.parquet(f"{tmp_path}/s")
    assert history.reset(spark, f"{tmp_path}/s") == 7 and ask(spark, "history", "--table", f"{tmp_path}/s")[0][-1] == 7
    assert ask(spark, "reset-history", "--table", f"{tmp_path}/s", "--apply") == [(7, True)]
    assert spark.read.parquet(f"{tmp_path}/s").count() == 0


def test_import_of_a_sheet(spark, tmp_path):
    lines = ["Mis comprobantes,,,", "", "Fecha,Tipo,Nro. Doc. Emisor,Denominación Emisor,Moneda,IVA 21%"]
    lines += [f'01/01/2024,Factura A,30-00000003-1,"Uno, SA",$,{i}' for i in range(3)] + ["01/01/2024,Factura A,30-00000007-1,Dos,$,0"]
    (tmp_path / "sheet.csv").write_text("\n".join(lines))
    found = command.run(spark, command.arguments(["import-catalogue", "--table", str(tmp_path / "sheet.csv"), "--out", str(tmp_path / "c")])).collect()
    assert [(r["tax_digits"], r["legal_name"], r["document_count"], r["vat_rates"]) for r in found] == [("30000000031", "Uno, SA", 3, [21.0])]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    (tmp_path / "none.csv").write_text("a,b\n" * 40)
    with pytest.raises(ValueError):
        suppliers.sheet_rows(spark, str(tmp_path / "none.csv"), ("Tipo",))


def catalogue(spark, rows):
    return suppliers.with_aliases(spark.createDataFrame([(i, n, d, c, a) for i, n, d, c, a in rows], "identifier string, legal_name string, display_name string, cuit string, aliases array<string>"))


def test_names_inside_words(spark):
    known = catalogue(spark, [("acme", "Acme Industrial SA", "Acme", "30-00000003-1", ["ACM", "Metalurgica"]), ("norte", "Proveedor Norte SRL", None, "30-00000007-1", []), ("sur", "Proveedor Sur SRL", None, "30-00000011-1", [])])
    texts = ["proveedorACME INDUSTRIAL SA", "la ACM vende", "la ACMX vende", "SUPERMETALURGICAS", "proveedor norte srl", "Proveedor Surtido", "x ACME INDUSTRIALES", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    found = {(r["doc_key"], r["identifier"]) for r in suppliers.candidates(docs, known, "1").collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = known.select("identifier", F.explode("names").alias("a")).select("identifier", "a.alias").collect()
    brute = set()
    for i, t in enumerate(texts):
        norm = " ".join("".join(c if c.isalnum() else " " for c in (t or "").upper()).split())
        brute |= {(i, r["identifier"]) for r in rows if (f" {r['alias']} " in f" {norm} " if len(r["alias"]) <= 4 else r["alias"] in norm)}
    marked = {(r["identifier"], a["alias"]): (a["is_legal"], a["is_trade"]) for r in known.collect() for a in r["names"]}
    assert found == {(i, s) for i, s in brute if any(t != (False, False) for (n, a), t in marked.items() if n == s and (f" {a} " in f" {norm_of(texts[i])} " if len(a) <= 4 else a in norm_of(texts[i])))}
    assert (0, "acme") in found and (4, "norte") in found and key("")


def norm_of(t):
    return " ".join("".join(c if c.isalnum() else " " for c in (t or "").upper()).split())


def test_lookups(spark):
    known = catalogue(spark, [("u", "Uno SA", "U", "30-00000003-1", []), ("d", "Dos SA", "D", "30-00000007-1", [])])
    asked = spark.createDataFrame([("u", "30 00000007 1"), ("z", "1")], "identifier string, cuit string")
    assert [r["legal_name"] for r in suppliers.lookup(asked, known).orderBy("identifier").collect()] == ["Uno SA", None]
    assert [r["legal_name"] for r in suppliers.lookup(asked, known, "cuit").orderBy("identifier").collect()] == ["Dos SA", None]
    with pytest.raises(Exception, match="proveedor desconocido"):
        suppliers.lookup(asked, known, required=True).collect()
    assert [r["identifier"] for r in suppliers.listed(known).collect()] == ["d", "u"]


def test_settings(tmp_path):
    assert config.from_environment({}).problems() == ["missing: EMAIL, APP_PASSWORD"]
    wrong = config.from_environment({"EMAIL": "a", "APP_PASSWORD": "b", "EMAIL_PROCESSING_LIMIT": "x", "LOG_LEVEL": "loud"})
    assert len(wrong.problems()) == 2
    assert config.daily_log(str(tmp_path), "INFO").parent == tmp_path


def test_evidence(spark):
    rows = spark.createDataFrame([("REMITO NO ES FACTURA", None, ["1"]), ("FACTURA", "A", []), ("FACTURA", None, ["1"])], "norm string, f string, ids array<string>")
    fields = {f: F.col("f") for f in run.CRITICAL}
    assert [r[0] for r in rows.select(run.enough_evidence(F.col("norm"), fields, F.col("f"), F.col("ids"))).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(run.told_candidates("ids")).collect()] == ['["1"]', "[]", '["1"]']
