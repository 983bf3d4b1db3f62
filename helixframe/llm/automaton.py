"""Regexes compiled together into one minimal deterministic byte automaton.

Rules are parsed, turned into one nondeterministic automaton over UTF-8 bytes (ASCII patterns), determinised by subset
construction over byte classes, minimised by partition refinement, and kept as a byte-class map, a transition array
and the rules that accept in each state.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from array import array
from dataclasses import dataclass

import numpy as np

FULL = (1 << 256) - 1


def _bits(codes) -> int:
    mask = 0
    for code in codes:
        mask |= 1 << code
    return mask


class Nfa:
    """States are integers; edges carry a 256-bit mask of bytes, 0 for an empty move."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, mask: int = 0) -> None:
        self.edges[a].append((mask, b))

    def add(self, tree, start: int, fold: bool) -> int:
        """Appends a parsed sequence after `start`; returns its end state."""
        for op, arg in tree:
            if op in (c.LITERAL, c.IN, c.ANY, c.NOT_LITERAL):
                end = self.state()
                self.link(start, end, self._mask(op, arg, fold))
                start = end
            elif op is c.SUBPATTERN:
                start = self.add(arg[3], start, fold)
            elif op is c.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.link(self.add(branch, start, fold), end)
                start = end
            elif op is c.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    start = self.add(inner, start, fold)
                if most is c.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.link(start, loop)
                    self.link(self.add(inner, loop, fold), loop)
                    self.link(loop, end)
                    start = end
                else:
                    end = self.state()
                    self.link(start, end)
                    for _ in range(most - least):
                        start = self.add(inner, start, fold)
                        self.link(start, end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return start

    def _mask(self, op, arg, fold: bool) -> int:
        if op is c.ANY:
            return FULL & ~(1 << 10)
        if op is c.IN:
            negate, mask = arg[0][0] is c.NEGATE, 0
            for kind, value in arg[negate:]:
                mask |= _bits(range(value[0], value[1] + 1)) if kind is c.RANGE else _bits([value])
        else:
            negate, mask = op is c.NOT_LITERAL, _bits([arg])
        if fold:
            for low in range(97, 123):
                if mask >> low & 1 or mask >> (low - 32) & 1:
                    mask |= 1 << low | 1 << (low - 32)
        return FULL & ~mask if negate else mask

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for mask, b in self.edges[todo.pop()]:
                if not mask and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def reversed(self, start: int, end: int) -> tuple[Nfa, int, int]:
        out = Nfa()
        out.edges = [[] for _ in self.edges]
        for a, edges in enumerate(self.edges):
            for mask, b in edges:
                out.link(b, a, mask)
        return out, end, start


@dataclass
class Dfa:
    """classes: byte -> class; next: state * n_classes + class -> state; accepts: rules by state; state 0 starts, `dead` never accepts."""

    classes: bytes
    n_classes: int
    next: array
    accepts: list[tuple[int, ...]]
    dead: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], unanchored: bool) -> Dfa:
    """Subset construction; unanchored restarts the rules at every byte. ends: NFA state -> rule."""
    masks = sorted({mask for edges in nfa.edges for mask, _ in edges if mask})
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(bool(m >> byte & 1) for m in masks), len(kinds)) for byte in range(256))
    by_class = [classes.index(k) for k in range(len(kinds))]
    first = nfa.closure([start])
    ids, todo, table = {first: 0}, [first], []
    cache: dict[int, frozenset] = {}
    for state in todo:
        row = []
        moves = [(mask, b) for a in state for mask, b in nfa.edges[a] if mask]
        for byte in by_class:
            to: set[int] = set(first) if unanchored else set()
            for mask, b in moves:
                if mask >> byte & 1:
                    if b not in cache:
                        cache[b] = nfa.closure([b])
                    to |= cache[b]
            key = frozenset(to)
            if key not in ids:
                ids[key] = len(ids)
                todo.append(key)
            row.append(ids[key])
        table.append(row)
    accepts = [tuple(sorted({ends[s] for s in state if s in ends})) for state in todo]
    return minimise(classes, np.array(table), accepts)


def minimise(classes: bytes, table: np.ndarray, accepts: list[tuple[int, ...]]) -> Dfa:
    """Merges states that accept the same rules and move alike, by refinement until nothing splits."""
    kinds: dict[tuple, int] = {}
    label = np.array([kinds.setdefault(a, len(kinds)) for a in accepts])
    while True:
        _, new = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        done, label = new.max() == label.max(), new
        if done:
            break
    order: dict[int, int] = {}
    for x in label:
        order.setdefault(int(x), len(order))
    members = {order[int(x)]: i for i, x in reversed(list(enumerate(label)))}
    rows = [[order[int(label[t])] for t in table[members[k]]] for k in range(len(order))]
    accepts = [accepts[members[k]] for k in range(len(order))]
    dead = next((k for k, row in enumerate(rows) if not accepts[k] and set(row) == {k}), -1)
    return Dfa(classes, table.shape[1], array("i", [t for row in rows for t in row]), accepts, dead)


def trigger(tree) -> list:
    """The shortest form of a rule whose last part repeats without bound: that part at its least count.

    It accepts at the same first position of each match, and keeps the joint automaton small: no rule stays
    "inside" its last part while the others move on.
    """
    items = list(tree)
    if items and items[-1][0] is c.MAX_REPEAT and items[-1][1][1] is c.MAXREPEAT:
        least, _, inner = items[-1][1]
        items[-1] = (c.MAX_REPEAT, (least, least, inner))
    elif items and items[-1][0] is c.SUBPATTERN:
        *head, inner = items[-1][1]
        items[-1] = (c.SUBPATTERN, (*head, trigger(inner)))
    return items


class Hit:
    """A state that accepts: not subscriptable, so that the scan loop stops right after it."""

    __slots__ = ("row", "rules")


class Scanner:
    """All rules in one pass: finds each rule's leftmost-longest matches that do not overlap one another."""

    def __init__(self, patterns: list[tuple[str, str, bool]]):
        """patterns: (name, regex, ignore case of ASCII letters)."""
        self.names = [name for name, _, _ in patterns]
        whole, start, ends = Nfa(), 0, {}
        start = whole.state()
        self.forward, self.backward = [], []
        for k, (_, regex, fold) in enumerate(patterns):
            tree = parser.parse(regex)
            begin = whole.state()
            whole.link(start, begin)
            ends[whole.add(trigger(tree), begin, fold)] = k
            own = Nfa()
            a = own.state()
            b = own.add(tree, a, fold)
            self.forward.append(determinise(own, a, {b: 0}, False))
            back, x, y = own.reversed(a, b)
            self.backward.append(determinise(back, x, {y: 0}, False))
        self.dfa = determinise(whole, start, ends, True)
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def rows(self) -> list:
        """The transition array as one list of 256 successors for each state."""
        if self._rows is None:
            d = self.dfa
            plain = [[] for _ in d.accepts]
            entry: list = list(plain)
            for k, rules in enumerate(d.accepts):
                if rules:
                    entry[k] = Hit()
                    entry[k].row, entry[k].rules = plain[k], rules
            for k, row in enumerate(plain):
                row += [entry[d.next[k * d.n_classes + cls]] for cls in d.classes]
            self._rows = plain
        return self._rows

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in the order of their ends' discovery."""
        found: list[tuple[int, int, int]] = []
        free = [0] * len(self.names)
        row, it, n = self.rows()[0], iter(data), len(data)
        while True:
            try:
                for b in it:
                    row = row[b]
            except TypeError:
                at = n - it.__length_hint__() - 1
                self._hit(data, at, row.rules, free, found)
                row = row.row[b]
                continue
            break
        if type(row) is Hit:
            self._hit(data, n, row.rules, free, found)
        return found

    def _hit(self, data: bytes, at: int, rules, free: list[int], found: list) -> None:
        for k in rules:
            if at > free[k] and (start := self._start(k, data, at, free[k])) is not None:
                end = self._end(k, data, start)
                found.append((start, k, end))
                free[k] = end

    def _start(self, k: int, data: bytes, at: int, least: int) -> int | None:
        d, state, best = self.backward[k], 0, None
        for i in range(at - 1, least - 1, -1):
            state = d.next[state * d.n_classes + d.classes[data[i]]]
            if d.accepts[state]:
                best = i
            elif state == d.dead:
                break
        return best

    def _end(self, k: int, data: bytes, start: int) -> int:
        d, state, best = self.forward[k], 0, start
        for i in range(start, len(data)):
            state = d.next[state * d.n_classes + d.classes[data[i]]]
            if d.accepts[state]:
                best = i + 1
            elif state == d.dead:
                break
        return best
