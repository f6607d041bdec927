"""The command line's three runs over folders, and sheets there and back."""

import json
import random
from email.message import EmailMessage

import pytest

from fiscora import __main__ as command
from fiscora import config
from fiscora.sources import sheets
from fiscora.sources import versions as store_versions
from fiscora.streaming import intake

SETTINGS = config.Settings(receiver="30711111111", receiver_name="RECEPTORA DE PRUEBA")
INVOICE = "%PDF-\nFACTURA A\nNro. 0001-0000000{n}\nFecha de Emisión: 03/04/2024\nRazón social: PRIMERA CASA SA\nCUIT: 30-00000003-1\nIVA 21% 10,00\nCAE TOTAL\n"


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def run(spark, *given):
    return command.run(spark, command.arguments([str(g) for g in given]), SETTINGS).collect()


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    pending = root / "_Pendientes"
    pending.mkdir(parents=True)
    (pending / "uno.pdf").write_text(INVOICE.format(n=1))
    (pending / "dos.pdf").write_text(INVOICE.format(n=2).replace("Fecha de Emisión: 03/04/2024\n", ""))
    (pending / "CCF_0001.pdf").write_text("no es un pdf")
    (pending / "precios.pdf").write_text("%PDF-\nLista de precios actualizada: presentación, precio sugerido")
    (pending / "nota.txt").write_text("no se mira")
    suppliers = {"schema_version": 1, "suppliers": [{"identifier": "primera", "legal_name": "Primera Casa SA", "display_name": "Primera", "cuit": "30-00000003-1", "aliases": [], "source": "x"}]}
    (tmp_path / "catalogue.json").write_text(json.dumps(suppliers))
    return root


def test_reprocess(spark, archive, tmp_path):
    before = tree(archive)
    given = ("reprocess", "--root", archive, "--catalogue", tmp_path / "catalogue.json")
    plan = {r["source"]: (r["status"], r["destination"], r["detail"]) for r in run(spark, *given)}
    place = "PRIMERA/2024/04/03-04FCA00001-00000001_RECEPTORA_DE_PRUEBA_PRIMERA.pdf"
    assert plan == {
        "_Pendientes/uno.pdf": ("would_moved", place, ""), "_Pendientes/precios.pdf": ("would_moved", "_Listas_De_Precios/precios.pdf", ""),
        "_Pendientes/dos.pdf": ("pendiente", "_Pendientes/dos.pdf", "Faltan: fecha"), "_Pendientes/CCF_0001.pdf": ("pendiente", "_Pendientes/CCF_0001.pdf", "el archivo no es un PDF legible"),
    }
    assert tree(archive) == before
    done = {r["source"]: r["status"] for r in run(spark, *given, "--apply")}
    assert done["_Pendientes/uno.pdf"] == done["_Pendientes/precios.pdf"] == "moved"
    assert sorted(tree(archive)) == sorted([place, "_Listas_De_Precios/precios.pdf", "_Pendientes/dos.pdf", "_Pendientes/CCF_0001.pdf", "_Pendientes/nota.txt"])
    assert {r["status"] for r in run(spark, *given)} == {"pendiente"}


def test_tax_profile(spark, archive, tmp_path):
    folder = archive / "PRIMERA/2024/04"
    folder.mkdir(parents=True)
    for n in (1, 2):
        (folder / f"{n}.pdf").write_text(INVOICE.format(n=n))
    (folder / "otra.pdf").write_text("%PDF-\nORIGINAL\nALMACEN DEL PUERTO SRL\nCUIT: 30-00000000-7\nPUNTO DE VENTA 0001\nIVA 10,5% 1,00\n")
    rows = run(spark, "tax-profile", "--root", archive, "--catalogue", tmp_path / "catalogue.json", "--out", f"file://{tmp_path}/out")
    assert [(r["supplier_name"], r["supplier_tax_id"], r["vat_21"], r["vat_10_5"]) for r in rows] == [("ALMACEN DEL PUERTO SRL", "30-00000000-7", "No", "Sí"), ("Primera", "30-00000003-1", "Sí", "No")]
    back = sheets.sheet_table(spark, f"file://{tmp_path}/out/part-00000.xlsx", ("supplier_name", "vat_21")).orderBy("row_no").collect()
    assert [(r["supplier_name"], r["vat_21"]) for r in back] == [("ALMACEN DEL PUERTO SRL", "No"), ("Primera", "Sí")] and len(back[0]) == 10


def test_mailbox_run(spark, tmp_path):
    (tmp_path / "mail").mkdir()
    m = EmailMessage()
    m["Subject"], m["Message-ID"] = "x", "<1@x>"
    m.set_content("hola")
    m.add_attachment(b"texto", maintype="application", subtype="pdf", filename="a.pdf")
    (tmp_path / "mail/1.eml").write_bytes(m.as_bytes())
    given = ("mailbox", "--root", f"file://{tmp_path}/mail", "--out", f"file://{tmp_path}/store", "--checkpoint", f"{tmp_path}/checkpoint")
    assert [tuple(r) for r in run(spark, *given)] == [(0, 1, 0)] and [tuple(r) for r in run(spark, *given)] == [(0, 0, 0)]
    assert [r["text"] for r in intake.results(spark, f"file://{tmp_path}/store").collect()] == ["texto"]
    assert len(store_versions.versions(spark, f"file://{tmp_path}/store")) == 1


def test_sheets_there_and_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"n{i:04d}", rng.choice(["Sí", "No", None, "", ' <&"> é\n x ', "12"]), rng.choice([None, "z"])) for i in range(250)]
    table = spark.createDataFrame(rows, "name string, `a b` string, c string").repartition(3)
    out = sheets.write_sheets(table, f"file://{tmp_path}/s", ["name"], "T & <x>", each=100).collect()
    assert sorted((r["path"], r["rows"]) for r in out) == [("part-00000.xlsx", 100), ("part-00001.xlsx", 100), ("part-00002.xlsx", 50)]
    back = sheets.sheet_table(spark, f"file://{tmp_path}/s/*.xlsx", ("name",)).orderBy("name").collect()
    assert [(r["name"], r["a b"], r["c"]) for r in back] == rows
    with pytest.raises(ValueError, match="no header row"):
        sheets.sheet_table(spark, f"file://{tmp_path}/s/part-00000.xlsx", ("missing",))


def test_cells_of_other_writers(tmp_path):
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{links}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/x.xml"/><Relationship Id="r2" Target="/xl/worksheets/y.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>uno</t></si><si><r><t>do</t></r><r><t>s</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/x.xml": f"<worksheet {ns}><sheetData/></worksheet>",
        "xl/worksheets/y.xml": f'<worksheet {ns}><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AA3"><v>3.0000000031E10</v></c></row><row><c t="b"><v>1</v></c><c t="str"><v>f</v></c><c><v>1.50</v></c><c/></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    rows = dict(sheets.cells(out.getvalue()))
    assert rows[3][:3] == [None, "uno", "dos"] and rows[3][26] == "30000000031" and rows[4] == ["1", "f", "1.50", None]
