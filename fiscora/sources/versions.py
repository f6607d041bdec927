"""Tables that change together. A version is a folder of Parquet tables and one small manifest that
names it; the manifest comes last, so readers see the version before or the whole new one, and it is
created only where none of its number is there, so of two writers one wins and the other is told.

store/data/<name>/<table>  the tables of a version
store/log/<number>         its manifest: the folder, the tables, a tag

A writer that dies leaves a folder that no manifest names, or an unreadable manifest, which counts as
none. A tag that is committed already is not committed again, so a repeated batch changes nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed this number."""


def _fs(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(store).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, store: str) -> list[dict]:
    """The committed manifests, oldest first."""
    fs, path = _fs(spark, store)
    log = path(f"{store}/log")
    if not fs.exists(log):
        return []
    out = []
    for status in fs.listStatus(log):
        if status.getPath().getName().isdigit():
            stream = fs.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                out.append(json.loads(text) | {"number": int(status.getPath().getName())})
            except ValueError:
                continue
    return sorted(out, key=lambda v: v["number"])


def _last_number(spark: SparkSession, store: str) -> int:
    fs, path = _fs(spark, store)
    log = path(f"{store}/log")
    return max([0, *(int(n) for s in fs.listStatus(log) if (n := s.getPath().getName()).isdigit())]) if fs.exists(log) else 0


def write(tables: dict[str, DataFrame], store: str) -> str:
    """The tables as a folder that nobody sees yet; its name."""
    folder = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.option("compression", "zstd").parquet(f"{store}/data/{folder}/{name}")
    return folder


def publish(spark: SparkSession, store: str, folder: str, tables: list[str], tag: str | None = None, after: int | None = None) -> int:
    """The manifest of a written folder, as the number behind `after` (or behind all there are); Conflict
    where somebody else has it."""
    fs, path = _fs(spark, store)
    number = (_last_number(spark, store) if after is None else after) + 1
    target = path(f"{store}/log/{number:012d}")
    try:
        stream = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            raise Conflict(f"{store}: version {number} is there") from e
        raise
    try:
        stream.write(bytearray(json.dumps({"folder": folder, "tables": tables, "tag": tag}).encode()))
    finally:
        stream.close()
    return number


def commit(spark: SparkSession, store: str, tables: dict[str, DataFrame], tag: str | None = None, after: int | None = None) -> int | None:
    """A new version of all of `tables`; its number, or None where the tag is committed already. after: the
    version that the tables were made from; if it is not the last one any more, Conflict."""
    if tag is not None and any(v["tag"] == tag for v in versions(spark, store)):
        return None
    return publish(spark, store, write(tables, store), list(tables), tag, after)


def current(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    """A table of the last version that has it; without one, no rows."""
    for v in reversed(versions(spark, store)):
        if table in v["tables"]:
            return spark.read.schema(schema).parquet(f"{store}/data/{v['folder']}/{table}")
    return spark.createDataFrame([], schema)


def appended(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    """What all versions together hold of a table that each only adds to."""
    paths = [f"{store}/data/{v['folder']}/{table}" for v in versions(spark, store) if table in v["tables"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, store: str, tables: list[str], keep: int = 2) -> int:
    """Delete the tables (not the appended ones) of all versions but the last `keep`; how many folders."""
    fs, path = _fs(spark, store)
    old = [path(f"{store}/data/{v['folder']}/{t}") for v in versions(spark, store)[:-keep] for t in tables]
    return sum(bool(fs.delete(p, True)) for p in old if fs.exists(p))
