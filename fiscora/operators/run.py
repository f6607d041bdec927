"""What a run tells at its end, when a reading needs a rescue (2.C C5), and candidates of
readings as text (2.I N19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL = ("document_type", "fiscal_letter", "document_number", "issue_date")


def final_summary(files: DataFrame, readings: DataFrame, detections: DataFrame) -> DataFrame:
    """One row of counts over files (saved, existed), readings (ok, has_text) and detections (done,
    detected, error). A missing flag counts as false; three aggregates with partial sums."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.count_if(c)
    f = files.agg(F.count("*").alias("pdf_found"), count(true("saved")).alias("pdf_new"), count(true("existed")).alias("pdf_existing"))
    r = readings.agg(count(true("ok")).alias("read_ok"), count(true("ok") & true("has_text")).alias("with_text"), count(true("ok") & ~true("has_text")).alias("without_text"), count(~true("ok")).alias("read_errors"))
    d = detections.agg(count(true("done")).alias("detections"), count(true("done") & true("detected")).alias("suppliers_found"), count(true("done") & ~true("detected")).alias("suppliers_missing"), count(~true("done")).alias("not_detected"), count(F.col("error").isNotNull()).alias("detection_errors"))
    return f.withColumn("_k", F.lit(0)).join(r.withColumn("_k", F.lit(0)), "_k").join(d.withColumn("_k", F.lit(0)), "_k").drop("_k")


def needs_rescue(detected: Column, fields: dict[str, Column]) -> Column:
    """Whether a first reading needs a second one: no supplier, or a critical field empty."""
    out = ~F.coalesce(detected, F.lit(False))
    for f in CRITICAL:
        out = out | (F.coalesce(F.trim(fields[f].cast("string")), F.lit("")) == "")
    return out


def enough_evidence(norm: Column, fields: dict[str, Column], identity: Column, valid_ids: Column) -> Column:
    """Whether reading may stop: a delivery note that says so needs a valid id, all else the four
    critical fields and an issuer."""
    note = norm.contains("REMITO") & norm.contains("NO ES FACTURA")
    every = identity.isNotNull()
    for f in CRITICAL:
        every = every & (F.coalesce(fields[f].cast("string"), F.lit("")) != "")
    return F.when(note, F.size(valid_ids) > 0).otherwise(every)


def told_candidates(candidates: Column) -> Column:
    """An array of candidates as JSON text."""
    return F.to_json(candidates)
