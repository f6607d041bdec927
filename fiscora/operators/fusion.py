"""Several readings of one document: quality, choice and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscora.functions import taxid
from fiscora.functions.cascade import ahead, bind, points
from fiscora.functions.text import upper_collapsed
from fiscora.operators import header, issuer
from fiscora.sources.scratch import materialised

FIELDS = ("document_type", "fiscal_letter", "document_number", "issue_date")
FIELD_POINTS = (9, 8, 10, 7)


def quality(text: Column, fields: dict[str, Column]) -> Column:
    """Length, words of a fiscal document, header fields, valid ids, and what speaks against."""
    every = None
    for c in fields.values():
        every = c.isNotNull() if every is None else every & c.isNotNull()
    header = points([(fields[f].isNotNull(), n) for f, n in zip(FIELDS, FIELD_POINTS, strict=True)]) + F.when(every, 12).otherwise(0)

    def told(norm: Column) -> Column:
        labelled = F.regexp_extract_all(norm, F.lit(ahead("C", r"\bCUIT\b[^0-9]{0,12}(\d{2}\s*[-.]?\s*\d{8}\s*[-.]?\s*\d)(?!\d)")), F.lit(1))
        wrong = F.size(F.filter(labelled, lambda x: ~taxid.valid(x)))
        words = points([(norm.rlike(ahead(w[0], rf"\b{w}\b")), n) for w, n in (("FACTURA", 4), ("NOTA DE (?:CREDITO|DEBITO)", 4), ("CUIT", 3), ("CAE", 3), ("IVA", 2), ("TOTAL", 2), ("FECHA", 1), ("PUNTO DE VENTA", 2), ("RESPONSABLE INSCRIPTO", 1))])
        return words + F.least(F.size(taxid.valid_in(norm)), F.lit(3)) * 8 - 10 * wrong

    # The text is normalised once, not for each word.
    shown = bind(upper_collapsed(text), told)
    return F.when(F.trim(text) == "", F.lit(-10000)).otherwise(F.least(F.floor(F.length(text) / 120), F.lit(4)) + header + shown).cast("long")


def best_reading(passes: DataFrame, key: str = "doc_key") -> DataFrame:
    """For each document the pass (method, text, score) with most points; the longer text on ties,
    then the first method."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("text")), "method")
    return passes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fused_fields(passes: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_key") -> DataFrame:
    """fields of the best pass, with gaps filled from the others in their order; what the
    better one says is never replaced."""
    order = F.struct(-F.col("score"), -F.length("text"), "method")
    return passes.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.min_by("method", order).alias("method"))


def evaluated(passes: DataFrame, receiver: str, receiver_name: str, key: str = "doc_key") -> DataFrame:
    """passes (key, method, text) that hold text, with the header, the issuer (`who`) and the score of each."""
    read = header.with_header(passes.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, "method", "text"))
    read = read.withColumn("score", quality(F.col("text"), {f: F.col(f) for f in FIELDS}))
    return read.select(key, "method", "text", "score", *FIELDS, F.explode(F.array(issuer.identity(F.col("text"), receiver, receiver_name))).alias("who"))


def _step(state: Column, r: Column) -> Column:
    """What reading r adds to the state: only fields that are missing, and an issuer if there is none yet.
    A type comes with its letter; a letter alone only from a reading of the same or of no type."""
    has = lambda c: c.isNotNull()
    who = state["who"].isNull() & has(r["who"])
    kind = state["document_type"].isNull() & has(r["document_type"])
    letter = has(state["document_type"]) & state["fiscal_letter"].isNull() & has(r["fiscal_letter"]) & (r["document_type"].isNull() | (r["document_type"] == state["document_type"]))
    number = state["document_number"].isNull() & has(r["document_number"])
    date = state["issue_date"].isNull() & has(r["issue_date"])
    lines = F.array_compact(F.array(
        F.when(who, F.concat(F.lit("RAZON SOCIAL: "), r["who"]["name"])), F.when(who, F.concat(F.lit("CUIT EMISOR: "), r["who"]["tax_id"])),
        F.when(kind, F.concat_ws(" ", r["document_type"], r["fiscal_letter"])), F.when(letter, F.concat_ws(" ", state["document_type"], r["fiscal_letter"])),
        F.when(number, F.lit("NUMERO DEL COMPROBANTE")), F.when(number, r["document_number"]), F.when(date, F.concat(F.lit("FECHA DE EMISION: "), r["issue_date"])),
    ))
    added = bind(lines, lambda x: F.struct(
        F.coalesce(state["who"], r["who"]).alias("who"), F.coalesce(state["document_type"], r["document_type"]).alias("document_type"),
        F.when(kind, F.coalesce(state["fiscal_letter"], r["fiscal_letter"])).when(letter, r["fiscal_letter"]).otherwise(state["fiscal_letter"]).alias("fiscal_letter"),
        F.coalesce(state["document_number"], r["document_number"]).alias("document_number"), F.coalesce(state["issue_date"], r["issue_date"]).alias("issue_date"),
        F.when(F.size(x) > 0, F.concat(state["parts"], F.array(F.array_join(x, "\n")))).otherwise(state["parts"]).alias("parts"),
        F.when(F.size(x) > 0, F.concat(state["methods"], F.array(r["method"]))).otherwise(state["methods"]).alias("methods"),
    ))
    return F.when(complete(state), state).otherwise(added)


def complete(state: Column) -> Column:
    """Whether nothing critical is missing, so that no further reading counts."""
    done = state["who"].isNotNull()
    for f in FIELDS:
        done = done & state[f].isNotNull()
    return done


def fused_reading(passes: DataFrame, receiver: str, receiver_name: str, key: str = "doc_key") -> DataFrame:
    """F1: (key, method, text, score) of each document's best reading (most points, then the longer text,
    then the greater method), or of what a fold over its readings in that order makes of it, where that
    scores higher. The fold starts with the best reading's text, never replaces what it has, adds what
    other readings have proven, not their text, and stops when nothing is missing.

    A document without any text has method sin_ocr and no text. The readings of one document are few (the
    passes of the reading chain), so they are gathered; no other group is."""
    read = materialised(evaluated(passes, receiver, receiver_name, key), "readings")
    row = F.struct("score", F.length("text").alias("n"), "method", "text", *FIELDS, "who")
    ordered = read.groupBy(key).agg(F.collect_list(row).alias("all"))
    first = lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).when(a["n"] != b["n"], b["n"] - a["n"]).when(a["method"] > b["method"], -1).when(a["method"] < b["method"], 1).otherwise(0).cast("int")
    ordered = ordered.select(key, F.array_sort("all", first).alias("all"))
    best = F.get("all", F.lit(0))
    start = F.struct(*[best[f].alias(f) for f in ("who", *FIELDS)], F.array(F.trim(best["text"])).alias("parts"), F.array(best["method"]).alias("methods"))
    folded = F.aggregate(F.slice("all", 2, 1_000_000), start, _step)
    staged = materialised(ordered.select(key, best.alias("best"), F.explode(F.array(folded)).alias("state")), "folded")
    changed = header.with_header(staged.where(F.size("state.parts") > 1).select(key, "best", "state", F.array_join("state.parts", "\n\n").alias("text")))
    rescored = changed.withColumn("points", quality(F.col("text"), {f: F.col(f) for f in FIELDS}))
    methods = F.concat(F.lit("fusion_ocr["), F.array_join(F.array_distinct("state.methods"), "+"), F.lit("]"))
    better = F.col("points") > F.col("best.score")
    pick = lambda new, old: F.when(better, new).otherwise(F.col(old))
    fused = rescored.select(key, pick(methods, "best.method").alias("method"), pick(F.col("text"), "best.text").alias("text"), pick(F.col("points"), "best.score").alias("score"))
    alone = staged.where(F.size("state.parts") == 1).select(key, "best.method", "best.text", "best.score")
    empty = passes.groupBy(key).agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("some")).where("NOT some")
    return alone.unionByName(fused).unionByName(empty.select(key, F.lit("sin_ocr").alias("method"), F.lit("").alias("text"), F.lit(-10000).cast("long").alias("score")))
