"""python -m fiscora MODE ... : the modes of the command line. What changes files or state
only shows its plan unless --apply is given."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscora import config
from fiscora.operators import amounts, suppliers
from fiscora.operators import files as plans
from fiscora.plans import documents as processing
from fiscora.sources import apply, documents, reading, sheets
from fiscora.sources.scratch import materialised
from fiscora.streaming import history, intake

MODES = ("mailbox", "reprocess", "tax-profile", "deduplicate", "audit-dates", "normalize-folders", "history", "reset-history", "import-catalogue")


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fiscora", description=__doc__)
    parser.add_argument("mode", choices=MODES)
    parser.add_argument("--root", help="the archive: a folder or URI that all executors share")
    parser.add_argument("--table", help="the mode's table (Parquet): dates (path, issue_date), aliases (alias, canonical), state; or the sheet (CSV)")
    parser.add_argument("--catalogue", help="the suppliers (JSON) for mailbox, reprocess and tax-profile; an earlier catalogue (Parquet) for import-catalogue")
    parser.add_argument("--out", help="where to write: the imported catalogue, the sheets of the tax profile, the mailbox's state and results")
    parser.add_argument("--checkpoint", help="the mailbox stream's checkpoint folder")
    parser.add_argument("--extractor", default="fiscora.sources.documents:plain_text", help="module:function from a file's bytes to its pages")
    parser.add_argument("--apply", action="store_true", help="do it instead of showing the plan")
    return parser.parse_args(given)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, folder, name, sha256) of all files outside of marked folders."""
    found = documents.files(spark, root, "*")
    start = root.rstrip("/").removeprefix("file://") + "/"
    rows = found.select(F.substring_index("path", start, -1).alias("path"), "name", F.sha2("content", 256).alias("sha256"))
    return rows.where(documents.outside_marked(F.col("path"))).withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))


def extractor(name: str) -> documents.Extractor:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def known_suppliers(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        return suppliers.read_catalogue(spark, path)
    return suppliers.with_aliases(spark.createDataFrame([], "identifier string, legal_name string, display_name string, cuit string, folder_name string, aliases array<string>"))


def texts(spark: SparkSession, a: argparse.Namespace, settings: config.Settings, root: str) -> DataFrame:
    """(doc_key, name, text, read_status, error) of the PDF files below root; doc_key is the path."""
    found = documents.files(spark, root)
    read = reading.read_chain(found.select("path", "content"), extractor(a.extractor), settings.receiver, settings.receiver_name)
    return read.select(F.col("path").alias("doc_key"), F.element_at(F.split("path", "/"), -1).alias("name"), "text", "read_status", "error")


def reprocess(spark: SparkSession, a: argparse.Namespace, settings: config.Settings) -> DataFrame:
    """L, F8: the files that are pending, looked at again. What is organised or archived is moved, the rest
    stays with its reason."""
    start = a.root.rstrip("/").removeprefix("file://") + "/"
    inside = lambda c: F.substring_index(c, start, -1)
    pending = f"{a.root.rstrip('/')}/_Pendientes"
    done = processing.process(texts(spark, a, settings, pending), known_suppliers(spark, a.catalogue), settings.receiver, settings.receiver_name)
    done = materialised(done.withColumn("source", inside(F.col("doc_key"))), "processed")
    hashes = documents.files(spark, pending).select(inside(F.col("path")).alias("source"), F.sha2("content", 256).alias("sha256"))
    wanted = done.where(F.col("status").isin("organizado", "archivado")).select("source", "destination").join(hashes, "source")
    plan = plans.move_plan(wanted, inventory(spark, a.root).select("path", "sha256"))
    stays = done.where(~F.col("status").isin("organizado", "archivado")).select("status", "source", F.col("source").alias("destination"), F.col("reason").alias("detail"))
    if a.apply:
        plan = apply.apply_plan(materialised(plan, "plan"), a.root)
    return plan.unionByName(stays)


def tax_profile(spark: SparkSession, a: argparse.Namespace, settings: config.Settings) -> DataFrame:
    """L, E16, B3: the profile of the archive's suppliers, each found by its catalogue, by its rules or by the
    layout, as sheets below --out."""
    start = a.root.rstrip("/").removeprefix("file://") + "/"
    docs = texts(spark, a, settings, a.root).where(documents.outside_marked(F.substring_index("doc_key", start, -1)))
    docs = materialised(docs.where("error IS NULL AND text <> ''").select("doc_key", "name", "text"), "archived")
    found = processing.resolved(docs, known_suppliers(spark, a.catalogue), settings.receiver, settings.receiver_name, processing.Rules())
    profile = materialised(amounts.profile_export(amounts.tax_profile(amounts.with_taxes(docs.join(found, "doc_key")))[0]), "profile")
    if a.out:
        materialised(sheets.write_sheets(profile, a.out, profile.columns[:2], "Perfil impositivo", [42, 18, *[12] * 7]), "written")
    return profile


def mail(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """L, A7, W3: what has come to the mailbox (--root), read and kept below --out, failures for the next run."""
    told = intake.run_mailbox(spark, a.root, intake.attachments_read(extractor(a.extractor)), a.out, a.checkpoint)
    counts = {k: sum(t.get(k, 0) for t in told) for k in ("skipped", "processed", "errors")}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


def run(spark: SparkSession, a: argparse.Namespace, settings: config.Settings | None = None) -> DataFrame:
    settings = settings or config.from_environment()
    if a.mode in ("mailbox", "reprocess", "tax-profile"):
        return {"mailbox": lambda: mail(spark, a), "reprocess": lambda: reprocess(spark, a, settings), "tax-profile": lambda: tax_profile(spark, a, settings)}[a.mode]()
    if a.mode == "history":
        return history.summary(spark.read.parquet(a.table))
    if a.mode == "reset-history":
        n = history.reset(spark, a.table, a.apply)
        return spark.createDataFrame([(n, a.apply)], "keys long, deleted boolean")
    if a.mode == "import-catalogue":
        names = {"Nro. Doc. Emisor": "tax_id", "Denominación Emisor": "name", "Tipo": "kind", "Moneda": "currency", "IVA 2,5%": "rate_25", "IVA 5%": "rate_5", "IVA 10,5%": "rate_105", "IVA 21%": "rate_21", "IVA 27%": "rate_27", "Otros Tributos": "other_taxes"}
        sheet = (sheets.sheet_table if a.table.lower().endswith(".xlsx") else suppliers.sheet_rows)(spark, a.table, tuple(names)[:4])
        number = lambda c: F.col(f"`{c}`").try_cast("double") if c in sheet.columns else F.lit(None).cast("double")
        rows = sheet.select("row_no", *[F.col(f"`{c}`").alias(n) if i < 4 else number(c).alias(n) for i, (c, n) in enumerate(names.items())])
        before = spark.read.parquet(a.catalogue) if a.catalogue else None
        if before is not None:
            kept = ("identifier", "legal_name", "display_name", "folder_name", "aliases")
            before = before.select(*[F.col(c) if c in before.columns else F.lit(None).cast("array<string>" if c == "aliases" else "string").alias(c) for c in kept])
        out = suppliers.import_catalogue(rows, previous=before)
        if a.out:
            apply.write_atomically(out, a.out)
        return out
    there = materialised(inventory(spark, a.root), "inventory")
    if a.mode == "deduplicate":
        plan, moved = plans.dedup_plan(there), "moved"
    elif a.mode == "audit-dates":
        plan, moved = plans.date_audit(spark.read.parquet(a.table).select("path", "issue_date"), there), "date_repaired"
    else:
        plan, moved = plans.folder_plan(there, spark.read.parquet(a.table)), "movido"
    if not a.apply:
        return plan
    done = materialised(apply.apply_plan(materialised(plan, "plan"), a.root, moved), "done")
    apply.prune(a.root)
    return done


def main(given: list[str]) -> int:
    settings = config.from_environment()
    config.daily_log(settings.log_folder, settings.log_level)
    if found := settings.problems(mailbox=False):
        print("\n".join(found), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("fiscora").getOrCreate()
    # Totals for the screen; the rows themselves may be many.
    out = materialised(run(spark, arguments(given), settings), "result")
    (out.groupBy("status").count() if "status" in out.columns else out).show(50, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
