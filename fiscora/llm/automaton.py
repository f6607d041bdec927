"""Regular expressions over bytes, compiled together into one minimal deterministic automaton.

compile_rules() parses each rule, joins them in one nondeterministic automaton (Thompson's
construction), makes it deterministic by subset construction over byte classes and minimises it by
partition refinement. The result is a set of arrays: byte -> class, (state, class) -> state, and
state -> bit mask of the rules that end there. Search is unanchored, so that any start is tried,
unless an anchored automaton is asked for; a backward one reads rules and text from their ends.

Syntax of rules: literals, \\xHH and other escapes, [classes], (groups), |, ?, *, +, {m}, {m,n}
and {m,} (n copies and a loop). Letters match either case in a group that begins with (?i: .
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Never part of UTF-8 text: it separates texts in a buffer and leads back to the start.
SEPARATOR = 0xFF


@dataclass
class Automaton:
    classes: np.ndarray  # uint8[256]
    table: np.ndarray  # int32[states * n_classes], premultiplied: entries are state * n_classes
    n_classes: int
    first_accepting: int  # premultiplied; all accepting states come last
    masks: np.ndarray  # int64[states]
    start: int = 0  # premultiplied; 0 unless the start accepts

    @cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        return self.table.tolist(), self.classes.tolist()

    @cached_property
    def dead(self) -> int:
        """The state that nothing leaves and no rule ends in, or -1."""
        rows = self.table.reshape(-1, self.n_classes)
        own = np.arange(len(rows)) * self.n_classes
        found = np.flatnonzero((rows == own[:, None]).all(1) & (self.masks == 0))
        return int(found[0]) * self.n_classes if len(found) else -1


class _Parser:
    def __init__(self, text: str, nfa: list[list[tuple[frozenset[int] | None, int]]], backward: bool = False):
        self.s, self.i, self.nfa, self.backward = text, 0, nfa, backward

    def state(self) -> int:
        self.nfa.append([])
        return len(self.nfa) - 1

    def alternatives(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            parts.append(self.sequence(fold))
        return ("or", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated(fold))
        return ("then", parts)

    def repeated(self, fold: bool):
        atom = self.atom(fold)
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            if c == "{":
                low, _, high = self.s[self.i + 1 : (end := self.s.index("}", self.i))].partition(",")
                bounds, self.i = (int(low), int(high) if high else (None if "," in self.s[self.i : end] else int(low))), end
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            self.i += 1
            atom = ("repeat", atom, *bounds)
        return atom

    def escape(self) -> frozenset[int]:
        c = self.s[self.i + 1]
        if c == "x":
            value, self.i = int(self.s[self.i + 2 : self.i + 4], 16), self.i + 4
            return frozenset([value])
        self.i += 2
        return {"d": frozenset(range(48, 58)), "n": frozenset([10])}.get(c, frozenset([ord(c)]))

    def atom(self, fold: bool):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            if self.s.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            inner = self.alternatives(fold)
            self.i += 1
            return inner
        if c == "[":
            self.i += 1
            found: set[int] = set()
            while self.s[self.i] != "]":
                one = self.escape() if self.s[self.i] == "\\" else self.plain()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]" and len(one) == 1:
                    self.i += 1
                    last = self.escape() if self.s[self.i] == "\\" else self.plain()
                    one = frozenset(range(min(one), min(last) + 1))
                found |= one
            self.i += 1
            return ("byte", self.folded(frozenset(found), fold))
        return ("byte", self.folded(self.escape() if c == "\\" else self.plain(), fold))

    def plain(self) -> frozenset[int]:
        self.i += 1
        return frozenset([ord(self.s[self.i - 1])])

    @staticmethod
    def folded(found: frozenset[int], fold: bool) -> frozenset[int]:
        return found | {b ^ 32 for b in found if chr(b).isalpha()} if fold else found

    def build(self, node, start: int) -> int:
        """Add node's states after start; the state where it ends."""
        kind = node[0]
        if kind == "byte":
            end = self.state()
            self.nfa[start].append((node[1], end))
            return end
        if kind == "then":
            for part in reversed(node[1]) if self.backward else node[1]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in node[1]:
                begin = self.state()
                self.nfa[start].append((None, begin))
                self.nfa[self.build(part, begin)].append((None, end))
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.nfa[start].append((None, loop))
            self.nfa[self.build(inner, loop)].append((None, loop))
            self.nfa[loop].append((None, end))
            return end
        end = self.state()
        self.nfa[start].append((None, end))
        for _ in range(high - low):
            start = self.build(inner, start)
            self.nfa[start].append((None, end))
        return end


def compile_rules(rules: list[str], max_states: int = 60_000, anchored: bool = False, backward: bool = False) -> Automaton:
    nfa: list[list[tuple[frozenset[int] | None, int]]] = [[]]
    ends = {}
    for k, rule in enumerate(rules):
        parser = _Parser(rule, nfa, backward)
        begin = parser.state()
        nfa[0].append((None, begin))
        ends[parser.build(parser.alternatives(False), begin)] = 1 << k

    # Bytes that no rule tells apart share a class; the separator has its own.
    marks = np.zeros(256, object)
    for i, found in enumerate({edge for edges in nfa for edge, _ in edges if edge is not None}):
        for b in found:
            marks[b] |= 1 << i
    marks[SEPARATOR] = -1
    order = {m: i for i, m in enumerate(dict.fromkeys(marks.tolist()))}
    classes = np.array([order[m] for m in marks.tolist()], np.uint8)
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(len(order))]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for edge, to in nfa[todo.pop()]:
                if edge is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    origin = closure([0])
    again = frozenset() if anchored else origin
    number, todo, table = {origin: 0}, [origin], []
    for states in todo:
        moves: dict[int, set[int]] = {}
        row = []
        for c, b in enumerate(samples):
            moves[c] = set() if b == SEPARATOR else {to for s in states for edge, to in nfa[s] if edge and b in edge}
            into = closure(moves[c]) | again if moves[c] else again
            if into not in number:
                if len(number) >= max_states:
                    raise ValueError(f"the rules need more than {max_states} states")
                number[into] = len(number)
                todo.append(into)
            row.append(number[into])
        table.append(row)
    masks = np.array([sum(bit for end, bit in ends.items() if end in states) for states in todo], np.int64)
    return _minimal(np.array(table, np.int64), masks, classes, len(order))


def _minimal(table: np.ndarray, masks: np.ndarray, classes: np.ndarray, n_classes: int) -> Automaton:
    """Merge states that no input tells apart: refine the partition by masks until it holds."""
    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:
        seen = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if seen.max() == block.max():
            break
        block = seen
    _, one = np.unique(block, return_index=True)
    # Accepting states last, and the start first of its kind.
    rank = np.lexsort((np.arange(len(one)), np.arange(len(one)) != block[0], masks[one] != 0))
    place = np.argsort(rank)
    small = place[block[table[one[rank]]]]
    kept = masks[one[rank]]
    return Automaton(classes, (small * n_classes).astype(np.int32).reshape(-1), n_classes, int((kept == 0).sum()) * n_classes, kept, int(place[block[0]]) * n_classes)


def scan(automaton: Automaton, data: bytes, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions just after which some rule ends, and the masks of those rules.

    The buffer is cut into lanes that advance together, one byte a step. Each lane starts as if a
    text began there; where the lane before it ended in another state, the lane is run again from
    that state until both runs agree, so the result is that of one run over the whole buffer.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_lanes = -(-n // lane)
    padded = np.full(n_lanes * lane, SEPARATOR, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    steps = np.ascontiguousarray(automaton.classes[padded].reshape(n_lanes, lane).T)
    states = np.empty((lane, n_lanes), np.int32)
    table, now = automaton.table, np.zeros(n_lanes, np.int32)
    for j in range(lane):
        now = table[now + steps[j]]
        states[j] = now
    entry = np.zeros(n_lanes, np.int32)
    while True:
        true_entry = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        wrong = np.flatnonzero(true_entry != entry)
        if not len(wrong):
            break
        entry[wrong] = now = true_entry[wrong]
        for j in range(lane):
            now = table[now + steps[j, wrong]]
            differ = now != states[j, wrong]
            wrong, now = wrong[differ], now[differ]
            if not len(wrong):
                break
            states[j, wrong] = now
    at, lanes = np.nonzero(states >= automaton.first_accepting)
    places = lanes.astype(np.int64) * lane + at
    order = np.argsort(places)
    return places[order] + 1, automaton.masks[states[at, lanes] // automaton.n_classes][order]


def farthest(automaton: Automaton, data: bytes, at: int, stop: int) -> int | None:
    """Where an anchored automaton that starts at `at` accepts last on its way to `stop` (a backward
    one goes down to it); None if it never does."""
    (table, classes), first, dead = automaton.lists, automaton.first_accepting, automaton.dead
    state = automaton.start
    found = at if state >= first else None
    back = stop < at
    for i in range(at - 1, stop - 1, -1) if back else range(at, stop):
        state = table[state + classes[data[i]]]
        if state >= first:
            found = i if back else i + 1
        elif state == dead:
            break
    return found
