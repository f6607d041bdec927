"""Applying a file plan: what operators.files has planned is done here, by
the tasks, on any file system that pyarrow knows. Every step may be repeated after a lost task."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscora.operators.files import applied

REMOVED = ("duplicate_removed", "duplicado_eliminado")
KEPT = ("conflict", "error", "ya_existia")


def same_content(store: fs.FileSystem, a: str, b: str, piece: int = 1 << 20) -> bool:
    with store.open_input_stream(a) as x, store.open_input_stream(b) as y:
        while True:
            p, q = x.read(piece), y.read(piece)
            if p != q:
                return False
            if not p:
                return True


def do(store: fs.FileSystem, root: str, status: str, source: str, destination: str | None) -> str:
    """Do one step of a plan; the empty string, or why it was not done."""
    there = lambda path: store.get_file_info(path).type == fs.FileType.File
    if status in KEPT:
        return ""
    a, b = posixpath.join(root, source), posixpath.join(root, destination or "")
    if not there(a):
        return "" if there(b) else "the source is gone"
    if status in REMOVED:
        # The copy goes only while its survivor is there and has the same bytes.
        if a == b or not there(b) or not same_content(store, a, b):
            return "the survivor is gone or differs"
        store.delete_file(a)
        return ""
    if there(b):
        if not same_content(store, a, b):
            return "the destination is taken"
        store.delete_file(a)
        return ""
    store.create_dir(posixpath.dirname(b), recursive=True)
    # Copied under another name first: a reader never sees half a file.
    store.copy_file(a, f"{b}.part")
    store.move(f"{b}.part", b)
    store.delete_file(a)
    return ""


def apply_plan(plan: DataFrame, root: str, moved: str = "moved") -> DataFrame:
    """plan (status, source, destination; paths below root, a URI that all executors share) done, with
    the status that it has now, or error and why. One bad row stops no other. Read the result once:
    it is what does the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            why = []
            for row in batch.itertuples():
                try:
                    why.append(do(store, base, row.status, row.source, row.destination))
                except Exception as e:
                    why.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"status": ["error" if w else s for w, s in zip(why, batch["status"], strict=True)], "source": batch["source"], "destination": batch["destination"], "detail": why})

    rows = plan.select(applied(F.col("status"), moved).alias("status"), "source", "destination")
    return rows.mapInPandas(run, "status string, source string, destination string, detail string")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Rows (status, destination, content) whose status is guardado written below root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            why = []
            for row in batch.itertuples():
                try:
                    if row.status == "guardado":
                        path = posixpath.join(base, row.destination)
                        store.create_dir(posixpath.dirname(path), recursive=True)
                        with store.open_output_stream(f"{path}.part") as out:
                            out.write(row.content)
                        store.move(f"{path}.part", path)
                    why.append("")
                except Exception as e:
                    why.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"status": ["error" if w else s for w, s in zip(why, batch["status"], strict=True)], "destination": batch["destination"], "detail": why})

    return rows.select("status", "destination", "content").mapInPandas(run, "status string, destination string, detail string")


def prune(root: str) -> int:
    """Remove the folders below root that hold no file, the deepest first; how many."""
    store, base = fs.FileSystem.from_uri(root)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    full = {p for f in found if f.type == fs.FileType.File for p in _above(f.path)}
    empty = sorted((f.path for f in found if f.type == fs.FileType.Directory and f.path not in full), key=len, reverse=True)
    for path in empty:
        store.delete_dir(path)
    return len(empty)


def _above(path: str) -> Iterator[str]:
    while (up := posixpath.dirname(path)) != path:
        yield up
        path = up


def write_atomically(rows: DataFrame, path: str) -> None:
    """Rows as Parquet at path, in place of what was there, complete or not at all. What was there is set
    aside, not deleted, until the new table stands; where a writer died in between, the next one puts it
    back first. Between the two renames a reader finds no table: those that must never miss one use
    sources.versions."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    new, old, target = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".new", ".old", ""))
    store = target.getFileSystem(conf)

    def rename(a, b) -> None:
        if not store.rename(a, b):
            raise OSError(f"cannot rename {a}")

    if store.exists(old):
        if store.exists(target):
            store.delete(old, True)
        else:
            rename(old, target)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    if store.exists(target):
        rename(target, old)
    rename(new, target)
    store.delete(old, True)
