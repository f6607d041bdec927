"""Secret scan by one deterministic automaton for all rules.

A rule is a head, which ends at one place, and a tail, which goes on as far as it can. The heads of
all rules are compiled once on the driver (automaton.py) into one automaton, which reads every text
once, byte by byte, many lanes at a time, and says where which heads end. From each such place the
backward automaton of the rule's head finds the earliest start, and the automaton of its tail the
end. So spans are leftmost and do not overlap within a kind; they are told in code points.

Defined results: a null or empty text has no spans; rows are judged one by one, so repeated rows
and repeated ids keep their own results; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscora.llm.automaton import Automaton, compile_rules, farthest, scan

#: Bytes of text that are scanned together.
BUFFER = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int = 0  # characters that the tail must have
    takes: bool = False  # a match with too short a tail takes its characters from later ones


#: The base kinds first, in their listed order.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", r"[A-Za-z0-9+/_.=-]*", 11, True),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]*", 13, True),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]*"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"([A-Za-z0-9+/=\x20\x09\x0a\x0d]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]*", 35),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]", r"[0-9A-Za-z-]*", 9),
    Rule("map_key", r"AIza[0-9A-Za-z_-]", r"[0-9A-Za-z_-]*", 34),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8}", r"[A-Za-z0-9_-]*(\.[A-Za-z0-9_-]*)?"),
)


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[Automaton]]:
    """The automaton of all heads, and each rule's backward one of its head and that of its tail."""
    starts = [compile_rules([r.head], anchored=True, backward=True) for r in rules]
    return compile_rules([r.head for r in rules]), starts, [compile_rules([r.tail], anchored=True) for r in rules]


class Scanner:
    def __init__(self, automata: tuple[Automaton, list[Automaton], list[Automaton]], rules: tuple[Rule, ...]):
        self.heads, self.starts, self.tails = automata
        self.rules = rules

    def spans(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of all spans of each text, by start and rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            if text:
                held.append(i)
                size += len(text)
            if held and (size >= BUFFER or i == len(texts) - 1):
                self.fill(texts, held, found)
                held, size = [], 0
        return found

    def fill(self, texts: list[bytes | None], held: list[int], found: list) -> None:
        data = b"\xff".join([texts[i] for i in held])
        ends, masks = scan(self.heads, data)
        if not len(ends):
            return
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in held[:-1]])
        own = np.searchsorted(starts, ends - 1, "right") - 1
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            text = texts[held[own[a]]]
            spans = []
            for k in range(len(self.rules)):
                if len(at := ends[a:b][masks[a:b] >> k & 1 > 0]):
                    spans += self.of_rule(k, text, (at - starts[own[a]]).tolist())
            if spans and not text.isascii():
                # Bytes that begin a character, up to each place.
                begun = np.append(0, np.cumsum(np.frombuffer(text, np.int8) >= -64))
                spans = [(int(begun[x]), k, int(begun[y])) for x, k, y in spans]
            found[held[own[a]]] = sorted(spans)

    def of_rule(self, k: int, text: bytes, ends: list[int]) -> list[tuple[int, int, int]]:
        """Spans of a rule whose head ends at these places, in bytes."""
        rule, taken, i, out = self.rules[k], 0, 0, []
        while i < len(ends):
            start = farthest(self.starts[k], text, ends[i], taken)
            if start is None:
                i += 1
                continue
            end = farthest(self.tails[k], text, ends[i], len(text))
            long_enough = end - ends[i] >= rule.least
            if long_enough:
                out.append((start, k, end))
            if long_enough or rule.takes:
                taken = end
                i = bisect_right(ends, end, i + 1)
            else:
                i += 1
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>) for every row, by start and then kind."""
    automata = compiled(tuple(rules))
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automata, rules)
        for batch in batches:
            spans = scanner.spans(batch.column(1).cast(pa.binary()).to_pylist())
            rows = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, FOUND)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def op6_secrets(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of each document."""
    told = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.expr("transform(filter(found, x -> x.kind IN ('assign', 'access', 'hex')), x -> concat_ws(':', x.kind, x.start, x.end))")
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return find_secrets(docs).select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(told, ",").alias("spans"))
