"""File plans, history in batch and as a stream, sources, and the registered queries."""

import datetime as dt
import json

from pyspark.sql import functions as F

import __spark_entry__
from fiscora.operators import files, suppliers
from fiscora.plans import catalogue
from fiscora.sources import documents
from fiscora.streaming import history

SCHEMA = "source_key string, attempt_no long, attempted_at timestamp, outcome string, pdf_count int, error string"


def attempts(spark, rows):
    at = lambda i: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=i)
    return spark.createDataFrame([(k, i, at(i), o, n, e) for i, (k, o, n, e) in enumerate(rows)], SCHEMA)


LOG = [("a", "ok", 2, None), ("b", "error", None, "E1"), ("c", "ok", 0, None), ("b", "ok", 1, None), ("a", "error", None, "E2")]


def test_fold(spark):
    state = history.fold(attempts(spark, LOG))
    found = {r["source_key"]: (r["status"], r["attempts"], r["last_error"], r["processed_at"] is None) for r in state.collect()}
    assert found == {"a": ("error", 2, "E2", True), "b": ("processed", 2, None, False), "c": ("no_pdf", 1, None, False)}
    assert history.summary(state).first().asDict() == {"processed": 1, "no_pdf": 1, "error": 1, "total": 3}
    assert history.summary(state.where("false")).first()["total"] == 0
    shuffled = history.fold(attempts(spark, LOG).repartition(3, F.rand(7)))
    assert sorted(shuffled.collect()) == sorted(state.collect())


def test_stream(spark, tmp_path):
    rows = attempts(spark, LOG)
    rows.where("attempt_no < 3").write.parquet(f"{tmp_path}/in/1")
    args = (spark, f"{tmp_path}/in/*", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    history.stream_attempts(*args).awaitTermination(120)
    rows.where("attempt_no >= 3").write.parquet(f"{tmp_path}/in/2")
    history.stream_attempts(*args).awaitTermination(120)
    history.stream_attempts(*args).awaitTermination(120)  # nothing new: no batch
    last = spark.read.parquet(f"{tmp_path}/out/state/batch=1")
    assert sorted(last.select("source_key", "status").collect()) == sorted(history.fold(rows).select("source_key", "status").collect())


def test_plans(spark):
    rows = spark.createDataFrame([("b/x", "h"), ("A/x", "h"), ("c", "i"), ("c2", None)], "path string, sha256 string")
    assert [tuple(r) for r in files.exact_duplicates(rows).select("duplicate", "survivor").collect()] == [("b/x", "A/x")]
    wanted = spark.createDataFrame([("s1", "d/f.pdf"), ("s2", "d/f.pdf"), ("s3", "d/g")], "source string, destination string")
    free = files.free_names(wanted, spark.createDataFrame([("d/f.pdf",)], "path string"))
    assert {r["source"]: r["final"] for r in free.collect()} == {"s1": "d/f_2.pdf", "s2": "d/f_3.pdf", "s3": "d/g"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("uno\fdos\f ".encode())
    (tmp_path / "m.eml").write_bytes(b'From: "A" <a@b.example>\r\nSubject: S\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="f.pdf"\r\n\r\n%PDF\r\n--x--\r\n')
    page = documents.with_pages(documents.files(spark, str(tmp_path), "*.txt")).first()
    assert (page["text"], page["n_pages"], page["n_text_pages"], page["error"]) == ("uno\n\ndos", 3, 2, None)

    def broken(content):
        raise ValueError("no")

    assert documents.with_pages(documents.files(spark, str(tmp_path), "*.txt"), broken).first()["error"] == "ValueError: no"
    mail = documents.mails(documents.files(spark, str(tmp_path), "*.eml")).first()
    assert (mail["subject"], [a["name"] for a in mail["attachments"]]) == ("S", ["f.pdf"])
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "suppliers": [{"identifier": "u", "legal_name": "Uno SA", "cuit": "30-00000003-1", "aliases": ["El Uno"]}]}))
    assert [a["alias"] for a in suppliers.read_catalogue(spark, str(tmp_path / "c.json")).first()["names"]] == ["EL UNO", "UNO", "UNO SA"]


def test_registered():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(catalogue.SQL) == {n for n in found if n.startswith("q_")}
