"""How a file becomes text. A text layer first, by a second reader where the first one fails;
where no page has text, optical passes in their order, each on the documents that still need it.

Readers and passes are plug-ins (functions from bytes), as their engines are not part of this library. What
is enough is judged by the engine's own expressions (operators.run.enough_evidence), so the passes run in
waves: each wave reads only the documents that no pass before has settled. There are as many waves as
passes. The readings of a document are then fused (operators.fusion)."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.functions import taxid
from fiscora.functions.text import upper_collapsed
from fiscora.operators import fusion, run
from fiscora.sources.documents import Extractor, joined_pages
from fiscora.sources.scratch import materialised

UPRIGHT = "upright"
#: Seconds that a pass may take for one document.
PATIENCE = 90.0


@dataclass(frozen=True)
class Pass:
    """An optical pass: its method, its function, and what it looks at. When one pass of the upright page
    is enough, no other one runs; one of a rotated page ends the passes of that rotation only."""

    method: str
    read: Callable[[bytes], str]
    view: str = UPRIGHT


@contextmanager
def patience(seconds: float):
    """TimeoutError after so many seconds, where signals can be had (the main thread of a worker)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def fault(content: Column) -> Column:
    """A3: why a file cannot be a readable PDF (C7's codes), or null: the mark in its first kilobyte is
    missing, or its end names an encryption."""
    head, tail = F.substring(content, 1, 1024), F.substring(content, -2048, 2048)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "pdf_invalido").when(~F.contains(text(head), F.lit("%PDF-")), "pdf_invalido").when(F.contains(text(tail), F.lit("/Encrypt")), "pdf_cifrado")


def text_layer(docs: DataFrame, first: Extractor, second: Extractor | None = None) -> DataFrame:
    """A4: docs (path, content) with pages, text, has_text, reader (1 or 2) and error. The second reader is
    asked only where the first one fails; an error is that row's alone."""
    schema = "path string, pages array<struct<numero:int,texto:string>>, reader int, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                error = None
                for n, reader in enumerate((first, second), 1):
                    if reader is None:
                        continue
                    try:
                        rows.append((path, [{"numero": i, "texto": t} for i, t in enumerate(reader(bytes(content)), 1)], n, None))
                        break
                    except Exception as e:
                        error = error or f"{type(e).__name__}: {e}"
                else:
                    rows.append((path, [], None, error))
            yield pd.DataFrame(rows, columns=["path", "pages", "reader", "error"])

    return joined_pages(docs.select("path", "content").mapInPandas(read, schema))


def one_pass(docs: DataFrame, p: Pass, seconds: float = PATIENCE) -> DataFrame:
    """(path, method, text, error) of one pass over docs (path, content); a failure or a pass that takes too
    long gives no text and stops nothing else."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with patience(seconds):
                        rows.append((path, p.method, p.read(bytes(content)) or "", None))
                except Exception as e:
                    rows.append((path, p.method, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "method", "text", "error"])

    return docs.select("path", "content").mapInPandas(read, "path string, method string, text string, error string")


def settled(readings: DataFrame, receiver: str, receiver_name: str) -> DataFrame:
    """The paths whose reading is enough."""
    found = fusion.evaluated(readings, receiver, receiver_name, "path")
    norm = upper_collapsed(F.col("text"), True)
    return found.where(run.enough_evidence(norm, {f: F.col(f) for f in run.CRITICAL}, F.col("who"), taxid.valid_in(norm))).select("path")


def optical(docs: DataFrame, passes: Sequence[Pass], receiver: str, receiver_name: str, seconds: float = PATIENCE) -> DataFrame:
    """A5: the readings (path, method, text, error) of docs (path, content) by `passes` in waves."""
    every, ended = None, None
    for p in passes:
        todo = docs
        if ended is not None:
            over = ended.where(F.col("view").isin(UPRIGHT, p.view)).select("path").distinct()
            todo = docs.join(over, "path", "left_anti")
        wave = materialised(one_pass(todo, p, seconds), "wave")
        every = wave if every is None else every.unionByName(wave)
        done = materialised(settled(wave, receiver, receiver_name).withColumn("view", F.lit(p.view)), "settled")
        ended = done if ended is None else ended.unionByName(done)
    return every


def read_chain(docs: DataFrame, first: Extractor, receiver: str, receiver_name: str, second: Extractor | None = None, passes: Sequence[Pass] = (), seconds: float = PATIENCE) -> DataFrame:
    """(path, text, read_status, method, error) of docs (path, content).

    read_status: no_necesario where the text layer has text; pdf_invalido, pdf_cifrado; sin_ocr where there
    are no passes; ocr_ok, ocr_sin_texto, and ocr_error where every pass failed. error: what no reader could
    do. A path names a document; an empty table gives an empty result."""
    docs = materialised(docs.select("path", "content", fault(F.col("content")).alias("fault")), "files")
    good = docs.where("fault IS NULL")
    layer = materialised(text_layer(good, first, second), "layer")
    nothing = F.lit(None).cast("string")
    bad = docs.where("fault IS NOT NULL").select("path", F.lit("").alias("text"), F.col("fault").alias("read_status"), nothing.alias("method"), nothing.alias("error"))
    failed = layer.where("error IS NOT NULL").select("path", F.lit("").alias("text"), F.lit("pdf_invalido").alias("read_status"), nothing.alias("method"), "error")
    read = layer.where("error IS NULL AND has_text").select("path", "text", F.lit("no_necesario").alias("read_status"), F.lit("texto").alias("method"), "error")
    blank = layer.where("error IS NULL AND NOT has_text").select("path")
    out = bad.unionByName(failed).unionByName(read)
    if not passes:
        return out.unionByName(blank.select("path", F.lit("").alias("text"), F.lit("sin_ocr").alias("read_status"), nothing.alias("method"), nothing.alias("error")))
    readings = optical(good.join(blank, "path", "left_semi").select("path", "content"), passes, receiver, receiver_name, seconds)
    best = fusion.fused_reading(readings, receiver, receiver_name, "path")
    tries = readings.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("ran"))
    status = F.when(F.trim("text") != "", "ocr_ok").when(F.col("ran") == 0, "ocr_error").otherwise("ocr_sin_texto")
    return out.unionByName(best.join(tries, "path").select("path", "text", status.alias("read_status"), "method", nothing.alias("error")))
