"""Documents from files and mail. PDF and OCR engines are plug-ins: a function
from bytes to pages; here text files and mail are read, which need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "array<struct<numero:int,texto:string,origen_texto:string,metodo_ocr:string,puntaje_ocr:int>>"
Extractor = Callable[[bytes], list[str]]


def files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """A3: path, name, length, content of the files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content")


def outside_marked(path: Column, depth: int | None = None) -> Column:
    """Not below a folder that begins with an underscore: at any depth, or as the first folder of
    a relative path."""
    return ~path.rlike(r"(?:^|/)_[^/]*/") if depth is None else ~path.rlike(r"^_[^/]*/")


def plain_text(content: bytes) -> list[str]:
    return content.decode("utf-8", "replace").split("\f")


def with_pages(docs: DataFrame, extract: Extractor = plain_text) -> DataFrame:
    """A4: docs (path, content) with pages and error. An extractor's exception is that row's error and
    stops nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = [{"numero": i, "texto": t, "origen_texto": "texto", "metodo_ocr": None, "puntaje_ocr": None} for i, t in enumerate(extract(bytes(content)), 1)]
                    rows.append((path, pages, None))
                except Exception as e:
                    rows.append((path, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return joined_pages(docs.select("path", "content").mapInPandas(run, f"path string, pages {PAGES}, error string"))


def joined_pages(docs: DataFrame) -> DataFrame:
    """docs with text (non-empty pages, a blank line between), and page counts."""
    filled = F.filter("pages", lambda p: F.trim(F.coalesce(p["texto"], F.lit(""))) != "")
    text = F.array_join(F.transform(filled, lambda p: F.trim(p["texto"])), "\n\n")
    return docs.withColumns({"text": text, "n_pages": F.size("pages"), "n_text_pages": F.size(filled), "has_text": F.size(filled) > 0})


def failure(status: Column) -> Column:
    """What a reading's status means."""
    out = F.when(status.isNull(), "sin estado de lectura")
    for code, why in (("sin_ocr", "no hay motor de OCR"), ("ocr_sin_texto", "el OCR no halló texto"), ("ocr_error", "el OCR falló"), ("pdf_cifrado", "el archivo está cifrado"), ("pdf_invalido", "el archivo no es un PDF legible")):
        out = out.when(status == code, why)
    return out.otherwise(F.concat(F.lit("estado desconocido: "), status))


def mails(raw: DataFrame) -> DataFrame:
    """Raw (path, content) of .eml files with subject, sender, message_date, message_id and
    attachments array<struct<name, mime, content>>."""
    schema = "path string, subject string, sender string, message_date string, message_id string, attachments array<struct<name:string,mime:string,content:binary>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    m = message_from_bytes(bytes(content), policy=policy.default)
                    parts = [p for p in m.walk() if not p.is_multipart() and (p.get_content_disposition() == "attachment" or p.get_filename())]
                    found = [{"name": p.get_filename() or "", "mime": p.get_content_type(), "content": p.get_payload(decode=True) or b""} for p in parts]
                    rows.append((path, str(m["Subject"] or "(sin asunto)"), str(m["From"] or ""), str(m["Date"] or ""), str(m["Message-ID"] or ""), found, None))
                except Exception as e:
                    rows.append((path, None, None, None, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "subject", "sender", "message_date", "message_id", "attachments", "error"])

    return raw.select("path", "content").mapInPandas(run, schema)


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file; broken ones are left out."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path).where("_corrupt IS NULL").drop("_corrupt")
