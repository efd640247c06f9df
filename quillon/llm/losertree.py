"""Front-coded runs of sorted byte strings, and their merge by a loser tree that never compares a known common prefix again."""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are certain."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes]:
    """(common prefix with the string before and length of the rest, two bytes a string; the rests) of sorted strings of at most 255 bytes."""
    heads, rests, last = bytearray(), [], b""
    for s in strings:
        n = common(last, s, 0)
        heads += bytes((n, len(s) - n))
        rests.append(s[n:])
        last = s
    return bytes(heads), b"".join(rests)


def decoded(heads: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, common prefix with the one before)."""
    last, at = b"", 0
    for i in range(0, len(heads), 2):
        n, more = heads[i], heads[i + 1]
        last = last[:n] + rests[at : at + more]
        at += more
        yield last, n


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the string given before) in the order of all strings; equal strings in the order of the runs.

    Each node of the tree keeps the loser of its match and the length of the
    prefix that the loser has in common with the winner. A string whose common
    prefix with the last winner is longer is the smaller one; only where two are
    equal are bytes compared, and from that length on.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    now: list[bytes | None] = [None] * width
    for i, r in enumerate(runs):
        got = next(r, None)
        now[i] = got[0] if got else None
    loser, shared = [0] * width, [0] * width

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner, its prefix with the last output, loser, its prefix with the winner."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, lb, a, 0) if x is None and y is not None else (a, la, b, 0)
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        n = common(x, y, la)
        first = len(x) <= len(y) if n == min(len(x), len(y)) else x[n] < y[n]
        if n == len(x) == len(y):
            first = a < b
        return (a, la, b, n) if first else (b, lb, a, n)

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            return node - width, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, loser[node], shared[node] = play(a, la, b, lb)
        return w, lw

    best, length = build(1)
    while now[best] is not None:
        yield best, length
        got = next(runs[best], None)
        now[best], length = got if got else (None, 0)
        node = (best + width) // 2
        while node:
            best, length, loser[node], shared[node] = play(best, length, loser[node], shared[node])
            node //= 2
