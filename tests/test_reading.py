"""The chain from bytes to text, with stubs for readers and passes; and the fold over readings."""

import time

from pyspark.sql import functions as F

from fiscora.operators import fusion
from fiscora.sources import reading

RECEIVER = ("30711111111", "RECEPTORA DE PRUEBA")
HEAD = "FACTURA A\nNro. 0001-00000002\nFecha de Emisión: 03/04/2024\n"
ISSUER = "ORIGINAL\nALMACEN DEL PUERTO SRL\nCUIT: 30-00000003-1\nPUNTO DE VENTA 0001\nInicio de actividades: 01/01/2000\n"
WHOLE = HEAD + ISSUER + "IVA CAE TOTAL"


def stubs():
    """Local, so that workers get them by value. A file's words say what each reader finds in it."""
    head, issuer, whole, rest = HEAD, ISSUER, WHOLE, time.sleep

    def first(content):
        if b"raro" in content:
            raise ValueError("raro")
        return ["", "capa"] if b"capa" in content else ["", " "]

    def second(content):
        if b"muyraro" in content:
            raise ValueError("muy raro")
        return ["otra"]

    def late(content):
        if b"lento" in content:
            rest(5)
        return whole if b"ya" in content else ""

    def halves(content):
        if b"falla" in content:
            raise OSError("falla")
        return head + "IVA CAE TOTAL FACTURA" if b"mitad" in content else ""

    def side(content):
        if b"falla" in content:
            raise OSError("falla")
        return issuer if b"mitad" in content else whole if b"tercera" in content else ""

    def upside(content):
        return "boca abajo"

    def third(content):
        return upside(content) if b"girado" in content else ""

    passes = [reading.Pass("psm_3", late), reading.Pass("psm_11", halves), reading.Pass("rot90_psm_6", side, "rot90"), reading.Pass("rot270_psm_6", third, "rot270")]
    return first, second, passes


def test_chain(spark):
    first, second, passes = stubs()
    files = {"capa": "no_necesario", "raro": "no_necesario", "muyraro": "pdf_invalido", "nada": "ocr_sin_texto", "ya": "ocr_ok", "mitad": "ocr_ok", "tercera": "ocr_ok", "girado": "ocr_ok", "lento": "ocr_sin_texto"}
    rows = [(n, f"%PDF-1.4 {n}".encode()) for n in files] + [("cifrado", b"%PDF-1.4 x trailer << /Encrypt 5 0 R >>"), ("texto", b"capa"), ("vacio", b""), ("nulo", None)]
    docs = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    found = {r["path"]: r for r in reading.read_chain(docs, first, *RECEIVER, second=second, passes=passes, seconds=1.0).collect()}
    assert {p: r["read_status"] for p, r in found.items()} == files | {"cifrado": "pdf_cifrado", "texto": "pdf_invalido", "vacio": "pdf_invalido", "nulo": "pdf_invalido"}
    assert found["capa"]["text"] == "capa" and found["raro"]["text"] == "otra" and found["muyraro"]["error"] == "ValueError: raro"
    assert found["ya"]["method"] == "psm_3" and found["tercera"]["method"] == "rot90_psm_6" and found["girado"]["text"] == "boca abajo"
    assert found["mitad"]["method"] == "fusion_ocr[psm_11+rot90_psm_6]"
    assert found["mitad"]["text"].endswith("RAZON SOCIAL: ALMACEN DEL PUERTO SRL\nCUIT EMISOR: 30-00000003-1")
    none = {r["path"]: r["read_status"] for r in reading.read_chain(docs, first, *RECEIVER, second=second).collect()}
    assert none["nada"] == "sin_ocr" and none["capa"] == "no_necesario"


def test_waves_stop_early(spark):
    _, _, passes = stubs()
    docs = spark.createDataFrame([(n, n.encode()) for n in ("ya", "tercera", "falla", "lento")], "path string, content binary")
    got = {}
    for r in reading.optical(docs, passes, *RECEIVER, seconds=1.0).collect():
        got.setdefault(r["path"], {})[r["method"]] = r["error"]
    assert list(got["ya"]) == ["psm_3"]  # upright and enough: nothing else
    assert set(got["tercera"]) == {"psm_3", "psm_11", "rot90_psm_6", "rot270_psm_6"}  # a rotation ends itself only
    assert got["falla"]["psm_11"] == "OSError: falla" and got["lento"]["psm_3"].startswith("TimeoutError")


def test_fold_is_refused_where_it_scores_no_higher(spark):
    ids = "CUIT 30-00000003-1 CUIT 30-00000000-7 CUIT 30-00000001-5 "
    rows = [(1, "a", HEAD + ids + "IVA CAE TOTAL PUNTO DE VENTA RESPONSABLE INSCRIPTO"), (1, "b", ISSUER), (2, "a", HEAD), (2, "b", HEAD), (3, "a", None), (3, "b", " "), (4, "a", "Nota de Credito B\nFecha de Emisión: 01/02/2024"), (4, "b", "FACTURA A\nNro 3-4")]
    passes = spark.createDataFrame(rows, "doc_key long, method string, text string")
    out = {r["doc_key"]: r for r in fusion.fused_reading(passes, *RECEIVER).collect()}
    assert out[1]["method"] == "a" and out[1]["text"] == rows[0][2]  # the issuer adds no points to three ids
    assert out[2]["method"] == "b" and out[3]["method"] == "sin_ocr" and out[3]["score"] == -10000
    lead = out[4]["text"].splitlines()
    assert out[4]["method"].startswith("fusion_ocr[") and not any(line.startswith(("FACTURA B", "NOTA DE CREDITO A")) for line in lead)
    assert not fusion.fused_reading(passes.where("false"), *RECEIVER).count()


def test_issuer_of_odd_texts(spark):
    from fiscora.operators import issuer

    long = "x\n" * 3000 + ISSUER
    rows = [(1, None, None), (2, "", "30-00000003-1"), (3, "\r\n \n", None), (4, long, None), (5, ISSUER.replace("\n", "\r\n"), None), (6, ISSUER, "30-00000000-7"), (7, ISSUER, "30-71111111-1"), (8, ISSUER, "123")]
    docs = spark.createDataFrame(rows, "doc_key long, text string, hint string")
    found = {r["doc_key"]: r for r in issuer.issuer_identity(docs, *RECEIVER, hint="hint").collect()}
    assert sorted(found) == [4, 5, 7, 8] and {r["name"] for r in found.values()} == {"ALMACEN DEL PUERTO SRL"}
    assert found[5]["evidence"][0] == "cuit_valido_distinto_del_receptor" and "inmediatamente_despues_de_marca_de_copia" in found[5]["evidence"]


def test_free_numbers(spark):
    import random

    from fiscora.operators import files

    rng = random.Random(4)
    for _ in range(3):
        names = ["D/x.pdf", "D/x_2.pdf", "D/x_3.pdf", "D/y", "D/.z", "D/x_02.pdf", "D/y_2"]
        wanted = [(f"s{i:03d}", rng.choice(names)) for i in range(60)]
        taken = [(p,) for p in rng.sample([*names, "D/x_5.pdf", "D/x_6.pdf", "D/x_1.pdf", "D/y_4", "D/x_2_2.pdf"], 6)]
        got = {r["source"]: r["final"] for r in files.free_names(spark.createDataFrame(wanted, "source string, destination string"), spark.createDataFrame(taken, "path string")).collect()}
        there, asked, expected = {p for p, in taken}, {d for _, d in wanted}, {}
        busy = there | asked
        for source, name in sorted(wanted):
            if name not in there and name not in expected.values():
                expected[source] = name
                continue
            stem, dot, ext = name.rpartition(".")
            stem, ext = (stem, dot + ext) if dot and "/" not in ext else (name, "")
            n = 2
            while (new := f"{stem}_{n}{ext}") in busy:
                n += 1
            busy.add(new)
            expected[source] = new
        assert got == expected and len(set(got.values())) == 60
    empty = spark.createDataFrame([], "source string, destination string")
    assert not files.free_names(empty, spark.createDataFrame(taken, "path string")).count()
