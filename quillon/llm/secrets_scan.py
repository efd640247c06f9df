"""Operator 3: secret scans by one combined deterministic automaton.

A rule is a head (a regex), then a run of body bytes of some least length. All
rules are compiled into one minimal automaton that is run once over the bytes of
each document and tells where a rule's head and first `trigger` body bytes end.
At such a place the rule's reversed automaton gives the leftmost beginning after
the rule's last match, and the run of body bytes gives the end; a run that is
too short is dropped (for the kind `assign` its bytes are used up). So matches are leftmost and
non-overlapping within a rule; those of different rules may overlap.

Null texts are empty. Offsets are code points, the end exclusive. Repeated rows
are scanned row by row. One narrow pass; no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, Scanner, byte_set, combined, reversed_dfa, _sre
from .common import prepare
from .textops import flat, sliced


@dataclass(frozen=True)
class Rule:
    kind: str
    head: bytes
    body: bytes
    least: int
    trigger: int = 1  # more only for an empty head: counters of several runs at once would multiply the states
    fold: bool = False  # letters of the head in either case
    spends: bool = False  # a run that is too short is used up all the same

    @property
    def pattern(self) -> bytes:
        return self.head + self.body + b"{%d}" % self.trigger


# The three base kinds, in the order in which ties are listed.
BASE = [
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", rb"[A-Za-z0-9+/_.=-]", 6, fold=True, spends=True),
    Rule("access", rb"AKIA", rb"[A-Z0-9]", 16),
    Rule("hex", rb"", rb"[0-9a-f]", 24, 24),
]
# Further kinds whose public formats are unmistakable.
FURTHER = [
    Rule("pem", rb"-----BEGIN ([A-Z]+ )*PRIVATE KEY", rb"-", 5),
    Rule("forge", rb"gh[oprsu]_", rb"[A-Za-z0-9]", 36),
    Rule("chat", rb"xox[abprs]-", rb"[A-Za-z0-9-]", 10),
    Rule("payment", rb"[rs]k_(live|test)_", rb"[A-Za-z0-9]", 16),
    Rule("cloud", rb"AIza", rb"[A-Za-z0-9_-]", 35),
    Rule("webtoken", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", rb"[A-Za-z0-9_-]", 10),
]


class SecretScanner:
    """The compiled rules. Picklable; compiled once on the driver."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = rules if rules is not None else [*BASE, *FURTHER]
        self.forward = combined([(fold_bodies(r), False) for r in self.rules])
        self.backward = [reversed_dfa(fold_bodies(r), False) for r in self.rules]
        self.bodies = []
        for r in self.rules:
            ((op, arg),) = list(_sre.parse(r.body))
            self.bodies.append(bytes(sorted(byte_set(str(op), arg, False))))
        self.scanner = Scanner(self.forward)

    def spans(self, raw: bytes, events) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted. events: (offset, rule bits), ascending."""
        found, used = [], [0] * len(self.rules)
        for at, bits in events:
            rule = 0
            while bits:
                if bits & 1 and at >= used[rule]:
                    start = leftmost(self.backward[rule], raw, at, used[rule])
                    if start >= 0:
                        r = self.rules[rule]
                        end = run_end(raw, at + 1, self.bodies[rule])
                        long = end - (at + 1 - r.trigger) >= r.least
                        if long:
                            found.append((start, rule, end))
                        if long or r.spends:
                            used[rule] = end
                bits >>= 1
                rule += 1
        return sorted(found)

    def column(self, column):
        """Spans in code points of each row of an Arrow string column."""
        data, offsets = flat(column)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        if not len(data):
            return out
        rows, at, bits = self.scanner.run(data, offsets)
        edges = np.flatnonzero(np.diff(rows, prepend=-1)).tolist() + [len(rows)]
        for lo, hi in zip(edges, edges[1:]):
            row = int(rows[lo])
            piece = data[offsets[row] : offsets[row + 1]]
            spans = self.spans(piece.tobytes(), zip(at[lo:hi].tolist(), bits[lo:hi].tolist()))
            if spans:
                points = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                out[row] = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
        return out


def fold_bodies(rule: Rule) -> bytes:
    """The rule's pattern, with the head's letters in both cases where the rule says so."""
    if not rule.fold:
        return rule.pattern
    head, inside, out = rule.head, False, b""
    for i, b in enumerate(head):
        c = bytes([b])
        if c == b"[" and head[i - 1 : i] != b"\\":
            inside = True
        elif c == b"]":
            inside = False
        escaped = head[i - 1 : i] == b"\\" or head[i - 3 : i - 1] == b"\\x" or head[i - 2 : i] == b"\\x"
        out += b"[" + c.lower() + c.upper() + b"]" if c.isalpha() and not inside and not escaped else c
    return out + rule.body + b"{%d}" % rule.trigger


def leftmost(dfa: Dfa, raw: bytes, at: int, floor: int) -> int:
    """Leftmost beginning, at floor or later, of a match that ends with raw[at]; -1 if there is none."""
    state, best, i = 0, -1, at
    while i >= floor:
        state = dfa.next[state, raw[i]]
        if state == dfa.dead:
            break
        if dfa.accepts[state]:
            best = i
        i -= 1
    return best


def run_end(raw: bytes, begin: int, body: bytes) -> int:
    """First offset from begin whose byte isn't in body."""
    step = 256
    while begin < len(raw):
        part = raw[begin : begin + step]
        rest = part.lstrip(body)
        if rest:
            return begin + len(part) - len(rest)
        begin += len(part)
        step *= 4
    return len(raw)


def scan(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end)."""
    prepare(docs.sparkSession)
    compiled = SecretScanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for part in sliced(batches, text):
            rows = [[{"kind": compiled.rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in compiled.column(part.column(text))]
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(key, text).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """scan() with its counts of the base kinds and the listings."""
    found = scan(docs, None, key, text)
    base = [r.kind for r in BASE]

    def listing(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in base),
        F.sha2(listing(own), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
