"""File plans: duplicates, conflicts, destinations, audits, folder names (SURVEY 2.B B5-B6, 2.C C1,
2.E J8-J9, 2.J P1-P7). Every plan is a table (status, source, destination, detail); nothing moves
until sources.apply.apply_plan() is called with it, and every plan says so (would_..., previsto_...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.functions.text import path_token
from fiscora.operators.filename import corrected_path, fiscal_key
from fiscora.operators.ranks import ranked
from fiscora.sources.scratch import materialised


def is_pdf(mime: Column, name: Column) -> Column:
    """C1."""
    return F.coalesce(F.lower(mime) == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(duplicate, survivor) of files (path, sha256): the survivor is the least path of a hash,
    regardless of case. The least path is an aggregate with partial sums joined back, so a content
    with a third of all files is not sorted in one task."""
    order = F.struct(F.lower("path").alias("l"), F.col("path").alias("p"))
    least = files.groupBy("sha256").agg(F.min(order).alias("m"), F.count("*").alias("n")).where("n > 1").select("sha256", F.col("m.p").alias("survivor"))
    return files.join(least, "sha256").where("path <> survivor").select(F.col("path").alias("duplicate"), "survivor", "sha256")


def dedup_plan(files: DataFrame) -> DataFrame:
    """P2."""
    return exact_duplicates(files).select(F.lit("would_remove").alias("status"), F.col("duplicate").alias("source"), F.col("survivor").alias("destination"), F.lit("identical content").alias("detail"))


#: A name that carries a number: what it would be without it, and the number.
NUMBERED = r"^(.*)_([1-9][0-9]{0,8})(\.[^./]*)?$"


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """P5: wanted (source, destination) with `final`: the destination for the first source that asks for
    it where no file is there, else the destination with the first free number from 2 on before its
    extension. A name that any source asks for is kept for the first of these, so the numbers do not
    depend on which name is looked at first.

    The k-th source left over gets the k-th free number. Let the taken numbers of a name stand in order,
    each with how many numbers below it are free; then k plus the taken numbers with fewer than k free
    ones below is the k-th free one, and that sum is a rank in both lists merged."""
    busy = taken.select(F.col("path").alias("destination")).distinct()
    asked = ranked(wanted, "destination", ["source"], "_nth").join(busy.withColumn("_busy", F.lit(1)), "destination", "left")
    asked = materialised(asked.withColumn("_k", F.col("_nth") - F.when(F.col("_busy").isNull(), 1).otherwise(0)).drop("_nth", "_busy"), "asked")
    left = asked.where("_k > 0")
    names = busy.unionByName(asked.select("destination")).distinct()
    part = lambda i: F.regexp_extract("destination", NUMBERED, i)
    numbers = names.where(F.col("destination").rlike(NUMBERED)).select(F.concat(part(1), part(3)).alias("destination"), part(2).cast("long").alias("number")).where("number > 1")
    numbers = ranked(numbers.join(left.select("destination").distinct(), "destination", "left_semi"), "destination", ["number"], "j")
    both = left.select("destination", F.col("_k").alias("at"), F.lit(0).alias("kind"), "source").unionByName(numbers.select("destination", (F.col("number") - F.col("j") - 1).alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    given = ranked(both, "destination", ["at", "kind"], "r").where("kind = 0").select("destination", F.col("at").alias("_k"), (F.col("r") + 1).alias("_number"))
    joined = asked.join(given, ["destination", "_k"], "left")
    stem, extension = F.regexp_replace("destination", r"(\.[^./]*)?$", ""), F.regexp_extract("destination", r"(\.[^./]*)$", 1)
    final = F.when(F.col("_number").isNull(), F.col("destination")).otherwise(F.concat(stem, F.lit("_"), F.col("_number").cast("string"), extension))
    return joined.withColumn("final", final).drop("_k", "_number")


def move_plan(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Wanted (source, destination, sha256) against inventory (path, sha256): identical
    content in the folder; the same fiscal key with other content (both stay); else moved."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    rows = wanted.withColumn("folder", folder(F.col("destination"))).withColumn("fkey", fiscal_key(F.regexp_replace("destination", "^.*/", "")))
    there = inventory.withColumn("folder", folder(F.col("path")))
    same = there.groupBy("folder", "sha256").agg(F.min("path").alias("same"))
    keyed = there.withColumn("fkey", fiscal_key(F.regexp_replace("path", "^.*/", ""))).where("fkey IS NOT NULL").groupBy("folder", "fkey").agg(F.min("path").alias("rival"))
    placed = free_names(rows, inventory).join(same, ["folder", "sha256"], "left").join(keyed, ["folder", "fkey"], "left")
    status = F.when(F.col("same").isNotNull(), "duplicate_removed").when(F.col("rival").isNotNull(), "fiscal_conflict").when(F.col("final") != F.col("destination"), "moved_with_suffix").otherwise("moved")
    return placed.select(F.concat(F.lit("would_"), status).alias("status"), "source", F.coalesce("same", "final").alias("destination"), F.coalesce("rival", F.lit("")).alias("detail"))


def date_audit(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files (path, issue_date) whose path does not tell the date: moved, or in conflict with a
    file that is there; unreadable dates are errors."""
    target = corrected_path(F.col("path"), F.col("issue_date"))
    rows = files.withColumn("destination", target).where(F.col("issue_date").isNull() | (F.col("destination") != F.col("path")))
    # The mark comes after the distinct paths, which are then shuffled once for both steps.
    there = inventory.select(F.col("path").alias("destination")).distinct().withColumn("taken", F.lit(True))
    status = F.when(F.col("issue_date").isNull(), "error").when(F.col("taken"), "conflict").otherwise("would_move")
    return rows.join(there, "destination", "left").select(status.alias("status"), F.col("path").alias("source"), "destination", F.when(F.col("issue_date").isNull(), "sin fecha").otherwise("").alias("detail"))


def folder_plan(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Files (path, folder, name, sha256) in folders that aliases (alias, canonical) rename.
    Previewed, unlike by most tools of this kind."""
    moved = files.join(aliases, files["folder"] == aliases["alias"]).withColumn("destination", F.concat_ws("/", "canonical", "name"))
    here = files.select(F.col("path").alias("destination"), F.col("sha256").alias("there")).dropDuplicates(["destination"])
    wanted = moved.select(F.col("path").alias("source"), "destination", "sha256")
    placed = free_names(wanted, files).join(here, "destination", "left")
    status = F.when(F.col("there") == F.col("sha256"), "duplicado_eliminado").when(F.col("final") == F.col("destination"), "movido").otherwise("movido_con_sufijo")
    return placed.select(F.concat(F.lit("previsto_"), status).alias("status"), "source", F.when(F.col("there") == F.col("sha256"), F.col("destination")).otherwise(F.col("final")).alias("destination"), F.lit("").alias("detail"))


def applied(status: Column, moved: str = "moved") -> Column:
    """What a planned status is called once it is done; `moved` names a plain move."""
    return F.when(status == "would_remove", "duplicate_removed").when(status == "would_move", moved).otherwise(F.regexp_replace(status, "^(would|previsto)_", ""))


def new_attachments(attachments: DataFrame, landing: DataFrame) -> DataFrame:
    """Attachments (name, mime, content) that are PDFs, with status guardado or, where the name is
    there already, ya_existia."""
    there = landing.select("name", F.lit(True).alias("there")).distinct()
    out = attachments.where(is_pdf(F.col("mime"), F.col("name"))).join(there, "name", "left")
    return out.withColumn("status", F.when(F.col("there"), "ya_existia").otherwise("guardado")).drop("there")


def sender_folder(sender: Column, sent: Column) -> Column:
    """The older layout SENDER/YYYY/MM - Month."""
    months = F.array(*[F.lit(m) for m in ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")])
    shown = F.regexp_extract(sender, r'^\s*"?([^"<]*?)"?\s*<', 1)
    name = F.trim(F.regexp_replace(F.when(shown != "", shown).otherwise(F.regexp_extract(sender, r"([^<>@\s]+)@", 1)), r'[<>:"/\\|?*]', "-"))
    return F.concat_ws("/", F.when(name == "", path_token(name)).otherwise(name), F.date_format(sent, "yyyy"), F.concat(F.date_format(sent, "MM"), F.lit(" - "), F.get(months, F.month(sent) - 1)))
