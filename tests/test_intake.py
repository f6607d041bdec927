"""The mailbox as a source, isolation of failures, dead letters, and tables that change together."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from fiscora.sources import mailbox, versions
from fiscora.streaming import history, intake


def put(folder, number, subject, *files, message_id=None):
    m = EmailMessage()
    if subject:
        m["Subject"] = subject
    m["From"] = "Casa <a@b.example>"
    if message_id:
        m["Message-ID"] = message_id
    m.set_content("hola")
    for name, content in files:
        m.add_attachment(content, maintype="application", subtype="pdf", filename=name)
    (folder / f"{number}.eml").write_bytes(m.as_bytes())


def readers():
    """One that fails on a word, and one that does not; local, so that workers get them by value."""

    def strict(content):
        if b"roto" in content:
            raise ValueError("roto")
        return [content.decode()]

    return strict, lambda content: [content.decode().replace("roto", "sano")]


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "server"
    out.mkdir()
    put(out, 1, "uno", ("a.pdf", b"texto a"), message_id="<1@x>")
    put(out, 2, "dos", message_id="<2@x>")
    put(out, 3, "", ("b.pdf", b"roto b"), ("c.pdf", b"texto c"), message_id="<3@x>")
    put(out, 7, "siete", ("d.pdf", b"texto d"))
    (out / "apuntes.txt").write_text("no es un mensaje")
    return out


def test_mailbox_batch(spark, folder):
    spark.dataSource.register(mailbox.Mailbox)
    read = lambda **o: spark.read.format("mailbox").options(folder=f"file://{folder}", **o).load()
    rows = {r["sequence"]: r for r in read(each="2").collect()}
    assert {n: (r["source_key"], r["subject"]) for n, r in rows.items()} == {1: ("message-id:<1@x>", "uno"), 2: ("message-id:<2@x>", "dos"), 3: ("message-id:<3@x>", "(sin asunto)"), 7: ("imap-sequence:7", "siete")}
    assert sorted(r["sequence"] for r in read(limit="2").collect()) == [3, 7]
    assert mailbox.row(9, mailbox.Server(f"file://{folder}").fetch)[0] == "imap-sequence:9"
    empty = folder.parent / "leer"
    empty.mkdir()
    assert not spark.read.format("mailbox").option("folder", f"file://{empty}").load().count()


def status(spark, store):
    return {r["source_key"]: (r["status"], r["attempts"], r["pdf_count"]) for r in versions.current(spark, store, "state", intake.STATE).collect()}


def test_dead_letters_are_tried_again(spark, folder, tmp_path):
    strict, lenient = readers()
    store, run = f"file://{tmp_path}/store", lambda extract: intake.run_mailbox(spark, f"file://{folder}", intake.attachments_read(extract), f"file://{tmp_path}/store", f"{tmp_path}/checkpoint")
    told = run(strict)
    assert [t["errors"] for t in told] == [1] and told[0]["processed"] == 3
    assert status(spark, store) == {"message-id:<1@x>": ("processed", 1, 1), "message-id:<2@x>": ("no_pdf", 1, 0), "message-id:<3@x>": ("error", 1, 2), "imap-sequence:7": ("processed", 1, 1)}
    dead = versions.current(spark, store, "dead", intake.DEAD).collect()
    assert [(r["source_key"], r["reason"], r["tries"]) for r in dead] == [("message-id:<3@x>", "ValueError: roto", 1)]
    found = {(r["name"], r["text"], r["error"]) for r in intake.results(spark, store).collect()}
    assert found == {("a.pdf", "texto a", None), ("b.pdf", "", "ValueError: roto"), ("c.pdf", "texto c", None), ("d.pdf", "texto d", None)}
    assert [r["source_key"] for r in history.errors(versions.current(spark, store, "state", intake.STATE)).collect()] == ["message-id:<3@x>"]

    run(strict)  # nothing new: the dead letter fails again
    assert status(spark, store)["message-id:<3@x>"] == ("error", 2, 2)
    put(folder, 8, "ocho", ("e.pdf", b"texto e"), message_id="<8@x>")
    run(lenient)
    assert status(spark, store)["message-id:<3@x>"] == ("processed", 3, 2) and status(spark, store)["message-id:<8@x>"] == ("processed", 1, 1)
    assert not versions.current(spark, store, "dead", intake.DEAD).count()
    found = {(r["name"], r["text"], r["error"]) for r in intake.results(spark, store).collect()}
    assert found == {("a.pdf", "texto a", None), ("b.pdf", "sano b", None), ("c.pdf", "texto c", None), ("d.pdf", "texto d", None), ("e.pdf", "texto e", None)}


def messages(spark, keys):
    return spark.createDataFrame([(k, i, "s", "f", "d", None, None) for i, k in enumerate(keys)], mailbox.SCHEMA)


def test_a_poisoned_message_costs_no_other(spark, tmp_path):
    store = f"file://{tmp_path}/store"

    def work(part):
        text = F.when(F.col("source_key").isin("k3", "k11"), F.raise_error(F.lit("veneno"))).otherwise(F.concat(F.lit("t"), "source_key"))
        return part.select("source_key", F.lit("x.pdf").alias("name"), text.alias("text"), F.lit(True).alias("has_text"), F.lit(None).cast("string").alias("error"))

    keys = [f"k{i}" for i in range(20)]
    assert intake.take_in(spark, messages(spark, keys), work, store, "a") == {"skipped": 0, "processed": 18, "errors": 2}
    assert intake.take_in(spark, messages(spark, keys), work, store, "a") == {"repeated": True}
    assert intake.take_in(spark, messages(spark, keys), work, store, "b", most_tries=1) == {"skipped": 18, "processed": 0, "errors": 0}
    dead = versions.current(spark, store, "dead", intake.DEAD).collect()
    assert sorted((r["source_key"], "veneno" in r["reason"]) for r in dead) == [("k11", True), ("k3", True)]
    assert intake.results(spark, store).where("error IS NULL").count() == 18
    with pytest.raises(Exception, match="veneno"):
        intake.isolated(messages(spark, keys), work, most_failures=1)
    assert intake.take_in(spark, messages(spark, []), work, f"{store}2", "a") == {"skipped": 0, "processed": 0, "errors": 0}


def test_versions(spark, tmp_path):
    store, rows = f"file://{tmp_path}/v", lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    read = lambda t="a": sorted(r["n"] for r in versions.current(spark, store, t, "n int").collect())
    assert read() == [] and versions.commit(spark, store, {"a": rows(1), "b": rows(9)}, "x") == 1
    assert versions.commit(spark, store, {"a": rows(2)}, "x") is None and read() == [1]
    half = versions.write({"a": rows(3)}, store)  # written, not published
    assert read() == [1]
    assert versions.commit(spark, store, {"a": rows(4)}, "y", after=1) == 2
    with pytest.raises(versions.Conflict):  # made from version 1, which is not the last any more
        versions.publish(spark, store, half, ["a"], after=1)
    assert read() == [4] and read("b") == [9]
    (tmp_path / "v/log/000000000003").write_text('{"fold')  # a writer that died in its manifest
    assert read() == [4] and versions.commit(spark, store, {"a": rows(5)}) == 4 and read() == [5]
    assert sorted(r["n"] for r in versions.appended(spark, store, "a", "n int").collect()) == [1, 4, 5]
    assert versions.vacuum(spark, store, ["a"], keep=1) == 2 and read() == [5]


def test_suppliers_noted_by_a_stream(spark, tmp_path):
    import datetime as dt

    from fiscora.operators import suppliers

    at = lambda d: dt.datetime(2024, 1, d)
    schema = "tax_id string, document_key string, name string, folder string, seen_at timestamp"
    rows = [("30-00000001-1", f"k{d}", f"A{d}", "F", at(d)) for d in (5, 6, 7, 7)] + [("30 00000001 1", "k1", "A0", "F", at(1))] + [("30-00000002-2", f"k{d}", "B", None, at(d)) for d in (1, 2)] + [("30-00000003-3", "k", "C", "F", at(1)), ("12", "k", "D", "F", at(1)), (None, "k", "D", "F", at(1))]
    known = spark.createDataFrame([("30000000033",)], "tax_id string")
    store, folder = f"file://{tmp_path}/store", tmp_path / "in"
    for n, part in enumerate((rows[:4], rows[4:], rows[:6])):  # the second is late, the third a repetition
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        history.stream_occasional(spark.readStream.schema(schema).parquet(str(folder)), store, f"{tmp_path}/c").awaitTermination()
        assert len(versions.versions(spark, store)) == n + 1
    got = {tuple(r) for r in history.noted_suppliers(spark, store, known).collect()}
    assert got == {tuple(r) for r in suppliers.occasional(spark.createDataFrame(rows, schema), known).collect()}
    assert {(r[1], r[3], r[6]) for r in got} == {("A7", 4, True), ("B", 2, False)}
    assert sum(spark.read.parquet(f"{tmp_path}/store/data/{v['folder']}/seen").count() for v in versions.versions(spark, store)) == 7
