"""Messages taken in once each, with a dead-letter table. What fails becomes a row with its reason
and is worked on again in the next run; the rest of its batch is committed. State, dead letters and results
of a batch become visible together (sources.versions), and a repeated batch changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscora.operators.files import is_pdf
from fiscora.sources import mailbox, versions
from fiscora.sources.documents import Extractor, mails, plain_text, with_pages
from fiscora.sources.scratch import materialised
from fiscora.streaming import history

STATE = "source_key string, status string, attempts long, pdf_count int, last_error string, last_no int, first_seen timestamp, last_attempt timestamp, processed_at timestamp"
DEAD = f"{mailbox.SCHEMA}, reason string, tries int"
RESULT = "source_key string, name string, text string, has_text boolean, error string"
MESSAGE = ("source_key", "sequence", "subject", "sender", "message_date", "content", "error")
#: From messages to a row for each document: source_key, name, text, has_text, error.
Work = Callable[[DataFrame], DataFrame]


def attachments_read(extract: Extractor = plain_text) -> Work:
    """The work of a mailbox: the text of each PDF attachment. A message or attachment that cannot be read is
    a row with its error; a message without PDFs has no row."""

    def work(messages: DataFrame) -> DataFrame:
        broken = messages.where("error IS NOT NULL").select("source_key", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("has_text"), "error")
        opened = materialised(mails(messages.where("error IS NULL").select(F.col("source_key").alias("path"), "content")), "opened")
        unread = opened.where("error IS NOT NULL").select(F.col("path").alias("source_key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("has_text"), "error")
        parts = opened.select("path", F.posexplode("attachments").alias("n", "a")).where(is_pdf(F.col("a.mime"), F.col("a.name")))
        named = parts.select(F.to_json(F.struct(F.col("path").alias("key"), "n", F.col("a.name").alias("name"))).alias("path"), F.col("a.content").alias("content"))
        pages = with_pages(named, extract)
        part = lambda c: F.get_json_object("path", f"$.{c}")
        done = pages.select(part("key").alias("source_key"), part("name").alias("name"), "text", "has_text", "error")
        return broken.unionByName(unread).unionByName(done)

    return work


def isolated(messages: DataFrame, work: Work, most_failures: int = 200) -> DataFrame:
    """work(messages) as a table. Where the whole of it fails, it is tried on halves (by hash of the key), and
    so on, until single messages fail: these become error rows. After most_failures failed jobs the fault is
    not the messages': the error goes on, nothing is committed, and the batch is repeated later."""
    done, failures, todo = [], 0, [(messages, 0)]
    while todo:
        part, depth = todo.pop()
        try:
            done.append(materialised(work(part), "worked"))
        except Exception as e:
            failures += 1
            if failures > most_failures:
                raise
            if depth >= 20 or part.limit(2).count() < 2:
                reason = f"{type(e).__name__}: {str(e).splitlines()[0][:500] if str(e) else ''}"
                done.append(part.select("source_key", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("has_text"), F.lit(reason).alias("error")))
            else:
                bit = F.shiftright(F.xxhash64("source_key"), depth).bitwiseAND(F.lit(1).cast("long"))
                todo += [(part.where(bit == side), depth + 1) for side in (0, 1)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def take_in(spark: SparkSession, messages: DataFrame | None, work: Work, store: str, tag: str, most_tries: int | None = None) -> dict:
    """One batch: messages (as the mailbox gives them) that are not done yet, and the dead letters of earlier
    batches (of fewer than most_tries tries, if given), worked on and committed under `tag`. Counts of
    what was skipped, processed and failed. A message that comes twice counts once."""
    if any(v["tag"] == tag for v in versions.versions(spark, store)):
        return {"repeated": True}
    after = max([0, *(v["number"] for v in versions.versions(spark, store))])
    state, dead = versions.current(spark, store, "state", STATE), versions.current(spark, store, "dead", DEAD)
    retried = dead if most_tries is None else dead.where(F.col("tries") < most_tries)
    parked = None if most_tries is None else dead.where(F.col("tries") >= most_tries)
    fresh = spark.createDataFrame([], mailbox.SCHEMA) if messages is None else messages.select(*MESSAGE)
    found = materialised(fresh.withColumn("tries", F.lit(0)).unionByName(retried.drop("reason")), "found")
    newest = found.groupBy("source_key").agg(*[F.max_by(c, "sequence").alias(c) for c in MESSAGE[1:]], F.max("tries").alias("tries"))
    if parked is not None:
        newest = newest.join(parked.select("source_key"), "source_key", "left_anti")
    todo = materialised(history.pending(newest, state), "todo")
    rows = materialised(isolated(todo.select(*MESSAGE), work), "documents")
    seen = rows.groupBy("source_key").agg(F.count("name").alias("n"), F.min("error").alias("reason"))
    done = materialised(todo.join(seen, "source_key", "left"), "done")
    failed = F.col("reason").isNotNull()
    attempts = done.select("source_key", (F.col("tries") + 1).alias("attempt_no"), F.current_timestamp().alias("attempted_at"), F.when(failed, "error").otherwise("ok").alias("outcome"), F.coalesce("n", F.lit(0)).cast("int").alias("pdf_count"), F.col("reason").alias("error"))
    fields = [f.split()[0] for f in STATE.split(", ")]
    after_state = history.merge(state, history.fold(attempts).select(*fields)).select(*[F.col(n).cast(f.split()[1]).alias(n) for n, f in zip(fields, STATE.split(", "), strict=True)])
    letters = done.where(failed).select(*MESSAGE, "reason", (F.col("tries") + 1).cast("int").alias("tries"))
    if parked is not None:
        letters = letters.unionByName(parked)
    versions.commit(spark, store, {"state": after_state, "dead": letters, "results": rows.select(*[f.split()[0] for f in RESULT.split(", ")])}, tag, after)
    versions.vacuum(spark, store, ["state", "dead"])
    n = done.agg(F.count("*").alias("n"), F.count_if(failed).alias("failed")).first()
    return {"skipped": newest.count() - n["n"], "processed": n["n"] - n["failed"], "errors": n["failed"]}


def results(spark: SparkSession, store: str) -> DataFrame:
    """The documents of all messages that are done, and the error rows of those that are not, each as its last
    attempt left it."""
    state = versions.current(spark, store, "state", STATE).select("source_key", "status")
    rows = versions.appended(spark, store, "results", RESULT).dropDuplicates()
    return rows.join(state, "source_key").where(F.col("error").isNull() | (F.col("status") == "error"))


def run_mailbox(spark: SparkSession, folder: str, work: Work, store: str, checkpoint: str, most_tries: int | None = None) -> list[dict]:
    """L, A7, W3: one run over a mailbox: first the dead letters of earlier runs, then all that has come
    since. Returns the counts of its batches."""
    spark.dataSource.register(mailbox.Mailbox)
    told = []
    if versions.current(spark, store, "dead", DEAD).limit(1).count():
        told.append(take_in(spark, None, work, store, f"retry-{uuid.uuid4().hex}", most_tries))
    stream = spark.readStream.format("mailbox").option("folder", folder).load()
    # Dead letters of this run wait for the next one.
    query = stream.writeStream.foreachBatch(lambda df, n: told.append(take_in(spark, df, work, store, f"batch-{n}", 0))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return told
