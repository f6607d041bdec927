"""Sheets of the zipped XML format, with the standard library. Reading streams a sheet's rows out of
its archive, a batch at a time; a sheet is one task, and its format ends at 1,048,576 rows. Writing makes as
many files as that limit needs, each in a task of its own.

Cells are texts: shared, inline and formula strings, numbers without exponents, booleans as 1 or 0. A
missing cell is null; rows and cells without a reference follow the one before."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscora.operators.ranks import ranked

MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _texts(node: ElementTree.Element) -> str:
    """The text of an item, its runs joined; readings of characters are no text."""
    return "".join(t.text or "" for run in node if run.tag != f"{_MAIN}rPh" for t in ([run] if run.tag == f"{_MAIN}t" else run.iter(f"{_MAIN}t")))


def _number(text: str) -> str:
    try:
        n = Decimal(text)
    except InvalidOperation:
        return text
    return str(n.quantize(Decimal(1))) if n == n.to_integral_value() else format(n, "f")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The path of the active sheet, the first one if none is told."""
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = tree.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    at = int(view.get("activeTab", "0")) if view is not None else 0
    link = tree.findall(f"{_MAIN}sheets/{_MAIN}sheet")[at].get(_LINK)
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == link:
            return posixpath.normpath(posixpath.join("xl", rel.get("Target"))) if not rel.get("Target").startswith("/") else rel.get("Target")[1:]
    raise ValueError("the workbook names no sheet")


def cells(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the active sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_texts(node))
                        node.clear()
        number = 0
        with book.open(_first_sheet(book)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value, kind = cell.findtext(f"{_MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        inline = cell.find(f"{_MAIN}is")
                        out[at] = _texts(inline) if inline is not None else None
                    elif value is not None:
                        out[at] = shared[int(value)] if kind == "s" else value if kind in ("str", "b", "e", "d") else _number(value)
                row.clear()
                yield number, out


def sheet_table(spark: SparkSession, path: str, required: tuple[str, ...], most: int = 25) -> DataFrame:
    """The rows of the sheets at path below their headers, with row_no: the header is the first of `most` rows
    that has all required names; a sheet without one is an error. Columns are those of the first sheet."""
    raw = spark.read.format("binaryFile").load(path)

    def header(content: bytes) -> tuple[int, list[str]]:
        for n, row in cells(content):
            names = [(x or "").strip() for x in row]
            if n > most:
                break
            if set(required) <= set(names):
                return n, names
        raise ValueError("no header row with the required names")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                below, names = header(bytes(content))
                held: list[tuple] = []
                for n, row in cells(bytes(content)):
                    if n > below:
                        held.append((n, dict(zip([x for x in names], row, strict=False))))
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=["row_no", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["row_no", "cells"])

    first = raw.orderBy("path").select("content").first()
    if first is None:
        raise ValueError(f"no sheet at {path}")
    names = [n for n in dict.fromkeys(header(bytes(first["content"]))[1]) if n]
    rows = raw.select("content").mapInPandas(read, "row_no long, cells map<string,string>")
    return rows.select("row_no", *[F.col("cells")[n].alias(n) for n in names])


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>{more}</Relationships>'
_STYLES = '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>'
#: Styles by number: plain, header, centred yes, centred no.
_LOOK = '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf><xf fillId="3" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf><xf fillId="4" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>'
_FILLS = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("1F4E78", "E2F0D9", "F2F2F2"))
HEADER, YES, NO = 1, 2, 3


def sheet_bytes(names: list[str], rows: Iterator[tuple], title: str, widths: list[int]) -> bytes:
    """A sheet with a frozen, styled header; "Sí" and "No" are centred and coloured."""
    out = io.BytesIO()
    cell = lambda x, style=0: "<c/>" if x is None else f'<c t="inlineStr"{f" s=\"{style}\"" if style else ""}><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'
    look = {"Sí": YES, "No": NO}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml", more="")), ("xl/workbook.xml", _BOOK.format(title=escape(title, {'"': "&quot;"}))), ("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml", more=_STYLES)), ("xl/styles.xml", _LOOK.format(fills=_FILLS))):
            book.writestr(zipfile.ZipInfo(name), text)
        with book.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w") as sheet:
            say = lambda text: sheet.write(text.encode())
            say('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView showGridLines="0" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>')
            say("".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols><sheetData>")
            say('<row r="1" ht="32" customHeight="1">' + "".join(cell(n, HEADER) for n in names) + "</row>")
            for i, row in enumerate(rows, 2):
                say(f'<row r="{i}">' + "".join(cell(x, look.get(x, 0)) for x in row) + "</row>")
            say("</sheetData></worksheet>")
    return out.getvalue()


def write_sheets(table: DataFrame, root: str, order: list[str], title: str = "Datos", widths: list[int] | None = None, each: int = MOST_ROWS - 1) -> DataFrame:
    """Table as sheets root/part-00000.xlsx and so on, in the order of `order`, `each` rows a file at most;
    (path, rows). Read the result once: it is what does the work, and may be repeated."""
    names = list(table.columns)
    sizes = widths or [18] * len(names)
    placed = ranked(table.withColumn("_all", F.lit(0)), "_all", order, "_n").withColumn("_file", F.floor((F.col("_n") - 1) / each).cast("int"))

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        rows = rows.sort_values("_n")
        store, base = fs.FileSystem.from_uri(root)
        path = f"part-{rows['_file'].iloc[0]:05d}.xlsx"
        store.create_dir(base, recursive=True)
        values = rows[names].astype(object).where(rows[names].notna(), None)
        with store.open_output_stream(posixpath.join(base, f"{path}.tmp")) as f:
            f.write(sheet_bytes(names, values.itertuples(index=False, name=None), title, sizes))
        store.move(posixpath.join(base, f"{path}.tmp"), posixpath.join(base, path))
        return pd.DataFrame({"path": [path], "rows": [len(rows)]})

    return placed.select("_file", "_n", *names).groupBy("_file").applyInPandas(save, "path string, rows long")
