"""Fill-in-middle over ropes.

A text becomes a rope: a balanced tree whose leaves are runs of whole lines and whose nodes cache the
line ends and the code points below them. Splitting at two line ranks walks down these counts, joining
makes one node, and neither copies more than the two leaves that are cut. The output is the joined
rearrangement with its sentinels; the inverse builds the output's rope, splits it at code-point ranks
around the sentinels and joins the parts in their first order.

Each row is decided by a keyed hash of its id alone, so any partitioning gives the same forms.

Defined results: a null or empty text is plain and empty; a text that holds a sentinel is plain; a text
of one line may have empty parts; a null id is hashed as no digits; rows with one id are cut by the same
draws, each by its own number of lines; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Code points of a leaf, unless one line has more.
LEAF = 2048


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def inside(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


class Rope:
    """A leaf (text) or a node (left, right), with its line ends and code points."""

    __slots__ = ("chars", "ends", "left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.ends, self.chars = text.count("\n"), len(text)
        else:
            self.ends, self.chars = left.ends + right.ends, left.chars + right.chars

    @staticmethod
    def of(text: str) -> Rope:
        """A balanced rope over leaves that end with a line's end."""
        leaves, at = [], 0
        while at < len(text):
            stop = text.find("\n", at + LEAF - 1) + 1 or len(text)
            leaves.append(Rope(text[at:stop]))
            at = stop
        while len(leaves) > 1:
            leaves = [joined(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else Rope()

    def lines(self) -> int:
        """Units: line ends, and a last line without one."""
        last = self
        while last.left is not None:
            last = last.right if last.right.chars else last.left
        return self.ends + (last.text[-1:] not in ("", "\n"))

    def split(self, rank: int, size: Callable[[Rope], int], cut: Callable[[str, int], int]) -> tuple[Rope, Rope]:
        """The ropes before and after `rank`, as counted by size() and, in a leaf, by cut()."""
        if not rank:
            return Rope(), self
        if self.left is None:
            at = cut(self.text, rank)
            return Rope(self.text[:at]), Rope(self.text[at:])
        if rank <= size(self.left):
            a, b = self.left.split(rank, size, cut)
            return a, joined(b, self.right)
        a, b = self.right.split(rank - size(self.left), size, cut)
        return joined(self.left, a), b

    def at_line(self, rank: int) -> tuple[Rope, Rope]:
        """Split behind `rank` lines; all of them if there are no more."""
        return (self, Rope()) if rank >= self.lines() else self.split(rank, lambda r: r.ends, _behind)

    def at_char(self, rank: int) -> tuple[Rope, Rope]:
        return self.split(rank, lambda r: r.chars, lambda text, k: k)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += (r.right, r.left)
        return "".join(out)


def _behind(text: str, lines: int) -> int:
    """Where the text's first `lines` lines end."""
    at = 0
    for _ in range(lines):
        at = text.index("\n", at) + 1
    return at


def joined(*parts: Rope) -> Rope:
    """One rope of all parts in their order; empty ones are left out."""
    out = None
    for p in parts:
        if p.chars:
            out = p if out is None else Rope(left=out, right=p)
    return out or Rope()


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: str, doc_id: int | None, seed: int, percent: int, spm_percent: int, marks: Sentinels) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and middle, output)."""
    whole = Rope.of(text)
    n = whole.lines()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or marks.inside(text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    front, suffix = whole.at_line(second)
    prefix, middle = front.at_line(first)
    p, s, m = Rope(marks.prefix), Rope(marks.suffix), Rope(marks.middle)
    spm = h4 % 100 < spm_percent
    out = joined(s, suffix, p, prefix, m, middle) if spm else joined(p, prefix, s, suffix, m, middle)
    return n, "spm" if spm else "psm", prefix.chars, middle.chars, str(out)


def restored(output: str, form: str, marks: Sentinels) -> str:
    """The text that rearranged() was given. Its parts hold no sentinel, so each mark is the first found."""
    if form == "plain":
        return output
    order = (marks.suffix, marks.prefix, marks.middle) if form == "spm" else (marks.prefix, marks.suffix, marks.middle)
    places, at = [], 0
    for mark in order:
        places.append(output.index(mark, at))
        at = places[-1] + len(mark)
    rest, parts = Rope.of(output), {}
    for mark, place in reversed(list(zip(order, places, strict=True))):
        rest, part = rest.at_char(place)
        parts[mark] = part.at_char(len(mark))[1]
    return str(joined(parts[marks.prefix], parts[marks.middle], parts[marks.suffix]))


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: Sentinels | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: `percent` of the texts are
    rearranged, `spm_percent` of these with the suffix first."""
    marks = marks or Sentinels()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(0).to_pylist()
                rows = [rearranged(t or "", i, seed, percent, spm_percent, marks) for i, t in zip(ids, part.column(1).to_pylist(), strict=True)]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def unfilled(outputs: DataFrame, marks: Sentinels | None = None) -> DataFrame:
    """fill_in_middle()'s rows with their text rebuilt from output and form alone, as `restored`."""
    marks = marks or Sentinels()
    schema = StructType([*outputs.schema.fields, StructField("restored", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [restored(o or "", f, marks) for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "restored"])

    return outputs.mapInArrow(work, schema)


def op11_fill_in_middle(docs: DataFrame) -> DataFrame:
    """Digests of each output and of the text that is restored from it."""
    out = unfilled(fill_in_middle(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
