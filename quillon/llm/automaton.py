"""Regexes over bytes to one minimal automaton: Thompson construction, subset construction, refinement."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_sre = re._parser  # the standard library's own parser; its tree is all that is used


class Nfa:
    """States with byte-set moves and empty moves. Each fragment is (start, end)."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def symbol(self, allowed: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a].append((allowed, b))
        return a, b

    def sequence(self, parts) -> tuple[int, int]:
        start = end = self.state()
        for a, b in parts:
            self.empty[end].append(a)
            end = b
        return start, end

    def either(self, parts) -> tuple[int, int]:
        a, b = self.state(), self.state()
        for x, y in parts:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def repeat(self, make, least: int, most: int | None) -> tuple[int, int]:
        parts = [make() for _ in range(least)]
        if most is None:
            x, y = make()
            a, b = self.state(), self.state()
            self.empty[a] += [x, b]
            self.empty[y] += [x, b]
            parts.append((a, b))
        else:
            for _ in range(most - least):
                x, y = make()
                self.empty[x].append(y)
                parts.append((x, y))
        return self.sequence(parts)

    def regex(self, tree, fold: bool, backward: bool) -> tuple[int, int]:
        items = list(tree)
        if backward:
            items.reverse()
        return self.sequence([self.item(op, arg, fold, backward) for op, arg in items])

    def item(self, op, arg, fold: bool, backward: bool) -> tuple[int, int]:
        name = str(op)
        if name in ("LITERAL", "IN", "ANY", "NOT_LITERAL"):
            return self.symbol(byte_set(name, arg, fold))
        if name == "SUBPATTERN":
            return self.regex(arg[3], fold, backward)
        if name == "BRANCH":
            return self.either([self.regex(x, fold, backward) for x in arg[1]])
        if name == "MAX_REPEAT":
            least, most, inner = arg
            return self.repeat(lambda: self.regex(inner, fold, backward), least, None if most == _sre.MAXREPEAT else most)
        raise ValueError(f"unsupported in a rule: {name}")


def byte_set(name: str, arg, fold: bool) -> frozenset:
    if name == "LITERAL":
        found = {arg}
    elif name == "NOT_LITERAL":
        found = set(range(256)) - {arg}
    elif name == "ANY":
        found = set(range(256)) - {10}
    else:
        found, negate = set(), False
        for op, x in arg:
            kind = str(op)
            if kind == "NEGATE":
                negate = True
            elif kind == "LITERAL":
                found.add(x)
            elif kind == "RANGE":
                found |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"unsupported in a class: {kind}")
        if negate:
            found = set(range(256)) - found
    if fold:
        letters = {b for b in found if chr(b).isascii() and chr(b).isalpha()}
        found |= {b ^ 32 for b in letters}
    return frozenset(found)


@dataclass
class Dfa:
    """next[state, byte], and the bit set of rules accepted in each state. State 0 starts; state `dead` (or -1) accepts nothing further."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], restart: bool) -> Dfa:
    """Subset construction. restart: a match may begin at any byte (the start stays in every subset)."""

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed([start])
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        targets: list[set] = [set() for _ in range(256)]
        for s in subset:
            for allowed, to in nfa.moves[s]:
                for b in allowed:
                    targets[b].add(to)
        row, known = [], {}
        for t in targets:
            key = frozenset(t)
            if key not in known:
                known[key] = closed(key) | first if restart else closed(key)
            to = known[key]
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = np.array([sum({1 << ends[s] for s in subset if s in ends}) for subset in order], np.int64)
    return minimised(np.array(rows, np.int32), accepts)


def minimised(table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Merge states until no byte tells two of one class apart (Moore's refinement)."""
    columns = np.unique(table, axis=1)
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[columns]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    # number classes by first appearance, so that the start is 0
    _, first = np.unique(group, return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    group = rank[group]
    keep = np.sort(first)
    merged, marks = group[table[keep]], accepts[keep]
    stuck = [i for i in range(len(merged)) if not marks[i] and (merged[i] == i).all()]
    return Dfa(merged, marks, stuck[0] if stuck else -1)


def combined(patterns: list[tuple[bytes, bool]]) -> Dfa:
    """One automaton that, after each byte, tells which patterns (regex, ignore ASCII case) end there."""
    nfa, parts, ends = Nfa(), [], {}
    for rule, (pattern, fold) in enumerate(patterns):
        a, b = nfa.regex(_sre.parse(pattern), fold, False)
        ends[b] = rule
        parts.append(a)
    start = nfa.state()
    nfa.empty[start] += parts
    return determinise(nfa, start, ends, True)


def reversed_dfa(pattern: bytes, fold: bool) -> Dfa:
    """Automaton of the pattern read backwards, anchored."""
    nfa = Nfa()
    a, b = nfa.regex(_sre.parse(pattern), fold, True)
    return determinise(nfa, a, {b: 0}, False)


class Scanner:
    """Runs a combined automaton over many documents at once.

    The bytes are laid out as SEGMENTS columns; all columns advance together, one
    byte a step, each from the start state. Then columns that in truth begin in
    another state run again from that state, until their states agree with the
    first run. A byte that UTF-8 never holds stands between documents and resets.
    """

    SEGMENT = 2048

    def __init__(self, dfa: Dfa):
        table = dfa.next.copy()
        table[:, 255] = 0
        self.table = (table.astype(np.int32) * 256).ravel()
        self.accepts = dfa.accepts

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, byte offset in it, rule bits) of each byte at which some rule ends."""
        rows = len(offsets) - 1
        total = len(data) + rows
        n = max(1, -(-total // self.SEGMENT))
        padded = np.full(n * self.SEGMENT, 255, np.uint8)
        where = np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))
        padded[where] = data
        by_step = np.ascontiguousarray(padded.reshape(n, self.SEGMENT).T)
        states = np.empty((self.SEGMENT, n), np.int32)
        s = np.zeros(n, np.int32)
        for i in range(self.SEGMENT):
            s = self.table.take(s + by_step[i])
            states[i] = s
        began = np.zeros(n, np.int32)
        while True:
            truly = np.concatenate([[0], states[-1][:-1]]).astype(np.int32)
            again = np.flatnonzero(truly != began)
            if not len(again):
                break
            began[again] = truly[again]
            s, i = truly[again], 0
            while len(again) and i < self.SEGMENT:
                s = self.table.take(s + by_step[i][again])
                differs = states[i][again] != s
                states[i][again] = s
                again, s, i = again[differs], s[differs], i + 1
        bits = self.accepts[states.T.ravel() >> 8]
        at = np.flatnonzero(bits)
        heads = offsets[:-1] + np.arange(rows)
        row = np.searchsorted(heads, at, side="right") - 1
        return row, at - heads[row], bits[at]
