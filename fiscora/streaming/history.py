"""Processing history as a fold of an append-only log of attempts (SURVEY 2.K W1-W5, 2.D G5, 2.E J6,
2.F T1, T4), in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscora.functions import taxid
from fiscora.operators import suppliers
from fiscora.sources import versions

DONE = ("processed", "no_pdf")
STATUSES = ("processed", "no_pdf", "error")


def source_key(gmail_id: Column, message_id: Column, sequence: Column) -> Column:
    """The most stable name of a message."""
    named = lambda prefix, c: F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(prefix), F.trim(c.cast("string"))))
    return F.coalesce(named("gmail:", gmail_id), named("message-id:", message_id), named("imap-sequence:", sequence))


def fold(attempts: DataFrame) -> DataFrame:
    """The state of each key from attempts (source_key, attempt_no, attempted_at, outcome,
    pdf_count, error): attempts counted, first sight kept, the rest as of the last attempt. A success
    without PDFs is no_pdf; an error clears processed_at. Aggregates only, so it runs on any size
    and the order of arrival does not matter."""
    status = F.when(F.col("outcome") == "error", "error").when(F.coalesce(F.col("pdf_count"), F.lit(0)) > 0, "processed").otherwise("no_pdf")
    rows = attempts.withColumn("status", status)
    last = F.struct("attempted_at", "attempt_no")
    at = lambda c: F.max_by(c, last)
    state = rows.groupBy("source_key").agg(at("status").alias("status"), F.count("*").alias("attempts"), at(F.coalesce("pdf_count", F.lit(0))).alias("pdf_count"), at(F.when(F.col("status") == "error", F.col("error"))).alias("last_error"), at("attempt_no").alias("last_no"), F.min("attempted_at").alias("first_seen"), F.max("attempted_at").alias("last_attempt"))
    return state.withColumn("processed_at", F.when(F.col("status").isin(*DONE), F.col("last_attempt")))


def merge(before: DataFrame, after: DataFrame) -> DataFrame:
    """The state that fold() gives for the attempts of two states together."""
    both = before.unionByName(after)
    last = F.struct("last_attempt", "last_no")
    at = lambda c: F.max_by(c, last).alias(c)
    state = both.groupBy("source_key").agg(at("status"), F.sum("attempts").alias("attempts"), at("pdf_count"), at("last_error"), at("last_no"), F.min("first_seen").alias("first_seen"), F.max("last_attempt").alias("last_attempt"), at("processed_at"))
    return state.select(*after.columns)


def reset(spark: SparkSession, path: str, apply: bool = False) -> int:
    """How many keys the state at path holds; all of them are deleted if it is to be applied."""
    rows = spark.read.parquet(path)
    n, schema = rows.count(), rows.schema
    if apply:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def summary(state: DataFrame) -> DataFrame:
    """Counts by status and in all, zeros included."""
    return state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def errors(state: DataFrame) -> DataFrame:
    """T4."""
    return state.where("status = 'error'").select("source_key", "attempts", "last_error", "last_attempt").orderBy(F.desc("last_attempt"), "source_key")


def pending(messages: DataFrame, state: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages (source_key, sequence) without those that are done. The limit takes the newest
    ones before the done ones are left out."""
    newest = messages.orderBy(F.desc("sequence")).limit(limit) if limit else messages
    return newest.join(state.where(F.col("status").isin(*DONE)).select("source_key"), "source_key", "left_anti")


def stream_attempts(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str):
    """Take in new Parquet files of attempts once each. Each batch is folded and merged into the
    state of the batch before, which its own folder out/state/batch=N holds whole; the last two stay.
    A repeated batch writes the same folder again. Returns the query, which ends when all there is has
    been read."""

    def batch(df: DataFrame, n: int) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{out}/state")
        store = at.getFileSystem(conf)
        held = sorted(int(f.getPath().getName().removeprefix("batch=")) for f in store.listStatus(at)) if store.exists(at) else []
        new = fold(df)
        if earlier := [k for k in held if k < n]:
            new = merge(spark.read.schema(new.schema).parquet(f"{out}/state/batch={earlier[-1]}"), new)
        new.write.mode("overwrite").parquet(f"{out}/state/batch={n}")
        for k in earlier[:-1]:
            store.delete(jvm.org.apache.hadoop.fs.Path(f"{out}/state/batch={k}"), True)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SEEN = "tax_digits string, document_key string, name string, folder string, seen_at timestamp"


def note_documents(spark: SparkSession, seen: DataFrame, store: str, tag: str) -> int | None:
    """Take in a batch of seen (tax_id, document_key, name, folder, seen_at): each document of a supplier
    is noted once for each way that it was seen, whenever and however often it comes. Only what is new is
    written (sources.versions), so a batch costs a join with the keys, not a rewrite of the state; a repeated
    batch changes nothing. Rows without a tax id of eleven digits or a document are left out."""
    rows = seen.select(taxid.digits(F.col("tax_id")).alias("tax_digits"), "document_key", "name", "folder", "seen_at").where("length(tax_digits) = 11 AND document_key IS NOT NULL").distinct()
    before = versions.appended(spark, store, "seen", SEEN)
    same = [rows[c].eqNullSafe(before[c]) for c in rows.columns]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return versions.commit(spark, store, {"seen": rows.join(before, on, "left_anti")}, tag)


def noted_suppliers(spark: SparkSession, store: str, catalogue: DataFrame, review_from: int = 3) -> DataFrame:
    """What suppliers.occasional() gives for all that has been noted, late and repeated rows included."""
    seen = versions.appended(spark, store, "seen", SEEN).withColumnRenamed("tax_digits", "tax_id")
    return suppliers.occasional(seen, catalogue, review_from)


def stream_occasional(seen: DataFrame, store: str, checkpoint: str):
    """note_documents() for each batch of a stream. Returns the query, which ends when all there is has been read."""
    note = lambda df, n: note_documents(df.sparkSession, df, store, f"batch-{n}")
    return seen.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
