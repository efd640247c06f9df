"""Operator 7: removal of repeated 100-byte strings by a distributed sort of suffixes.

A byte goes if a LENGTH-byte string over it also starts earlier (smaller doc_id,
or same document and earlier). Sorting every suffix of the corpus would move each
byte a hundred times; only suffixes at *anchors* are exchanged:

1. Every LENGTH-byte string holds LENGTH - GRAM + 1 grams of GRAM bytes; those
   of least hash are its anchors. Equal strings have equal anchors at equal
   places, so strings need comparing only where anchors agree. One pass gives of
   each anchor its hash, a hash of its *segment* (all strings that it serves, about
   33, and the anchor's place in it), and its position. Sorted by these, anchors
   of equal segments but the first are repeats, whole; an anchor whose gram has
   but one segment serves no repeat from elsewhere. Both are settled.
2. What is left, first segments of grams with several, lies at the edges of
   repeated passages. Their suffixes are read again, sorted in each task, and
   exchanged as front-coded runs (bytes that a suffix shares with the one before
   are not sent); each bucket's runs are merged by a loser tree that starts each
   comparison behind the known common prefix. Suffixes that share a gram come
   together, and the strings around them are matched by the common prefixes that
   the merge knows and those of the sorted left contexts, byte by byte; of equal
   ones the earliest stays. Grams with more than HOT segments take another way:
   their strings are hashed one by one, reduced to the earliest within a task, and
   dealt by that hash, so that no task gathers them all.
3. Settled anchors and matched strings meet their documents, and the covered
   bytes are cut out.

Settled segments and strings of hot grams trust 128 bits (the hash of the gram and
that of the segment or string); all other matches compare bytes. Null texts are
empty. Rows that share a doc_id are judged as one document: equal strings at equal
offsets of such rows don't remove each other. Rows with a null id lose nothing.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_count, fresh, prepare, written
from .losertree import common, decoded, front_coded, merged
from .textops import U64, flat, mix, powers, sliced

LENGTH = 100
GRAM = 36
SPAN = LENGTH - GRAM + 1  # grams in a string
HOT = 2000
SALTS = 32  # parts of a hot gram's anchors when they are told so
BUCKET_UNITS = 20_000  # suffixes of a bucket, about
RUN_BYTES = 24 << 20  # suffixes that a task sorts at once

NO_HASH = U64(2**64 - 1)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for each i; shorter at the end."""
    done, out = 1, x.copy()
    while done < width:
        step = min(done, width - done)
        if step < len(out):
            out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


class Anchors:
    """The anchors of the documents of a slice, and the strings that they serve."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        base, self.inverse = powers(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * base[:n], out=self.total[1:])
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            self.at = self.low = self.high = self.row = none
            self.hash = none.astype(U64)
            return
        h = np.full(n, NO_HASH)
        h[: n - GRAM + 1] = self.hashes(np.arange(n - GRAM + 1), GRAM)
        ends = offsets[1:]
        row_of_end = np.repeat(ends, np.diff(offsets))  # end of each byte's document
        place = np.arange(n)
        h[place + GRAM > row_of_end] = NO_HASH
        least = sliding(h, SPAN, np.minimum)  # of the string at each place
        least[place + LENGTH > row_of_end] = 0
        # the largest `least` among the strings that hold the gram at a place: the gram serves one if it is its own hash
        back = np.zeros(n, U64)
        back[:] = sliding(least[::-1], SPAN, np.maximum)[::-1]
        at = np.flatnonzero((back == h) & (h != NO_HASH) & (h != 0))
        self.at, self.hash = at, h[at]
        self.row = np.searchsorted(offsets, at, side="right") - 1
        # strings served: a run of places, within SPAN - 1 before the anchor, whose least hash is the anchor's
        first = offsets[:-1][self.row]
        changed = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        run_start = changed
        run_end = np.append(changed[1:], n)
        value = least[run_start]
        # the run that ends at or reaches the anchor: the last place <= at with the anchor's hash
        run = np.searchsorted(run_start, at, side="right") - 1
        wrong = value[run] != self.hash
        while wrong.any():
            run[wrong] -= 1
            wrong = (value[run] != self.hash) & (run > 0)
        self.high = np.minimum(run_end[run] - 1, at)
        self.low = np.maximum(np.maximum(run_start[run], at - SPAN + 1), first)

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.inverse[start])

    def segment_hashes(self) -> np.ndarray:
        long = self.high - self.low + LENGTH
        whole = self.hashes(self.low, long)
        return mix(whole + (self.at - self.low).astype(U64) * U64(0x9E3779B97F4A7C15) + long.astype(U64))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def anchor_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """h, c, doc, pos of each anchor; pos is negative (~pos) for an anchor that repeats one of its slice."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            a = Anchors(data, offsets)
            if not len(a.at):
                continue
            doc = ids_of(part.column(key))[a.row]
            pos, c = a.at - offsets[:-1][a.row], a.segment_hashes()
            h = a.hash
            order = np.lexsort((pos, doc, c, h))
            h, c, doc, pos = h[order], c[order], doc[order], pos[order]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            # equal places of rows that share an id aren't repeats of each other
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            twin = again & (doc == doc[head]) & (pos == pos[head])
            keep = ~twin
            h = np.where(again, mix(h ^ doc.astype(U64)), h)  # settled; anywhere
            pos = np.where(again, ~pos, pos)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].view(np.int64)), pa.array(doc[keep]), pa.array(pos[keep])], schema=schema)

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "h long, c long, doc long, pos long")


def settle(anchors: DataFrame) -> DataFrame:
    """h, doc, pos, state: 1 for repeats, 0 for first segments of grams with several; settled firsts go."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("state", pa.int32())])

    def run(batches):
        last = None  # (h, c, doc, pos) of the last first segment
        several, held = False, None  # whether its gram has several; the first segment not yet given out
        for b in batches:
            h, c, doc, pos = (b.column(n).to_numpy() for n in ("h", "c", "doc", "pos"))
            flagged = pos < 0
            if flagged.any():
                yield out(h[flagged], doc[flagged], ~pos[flagged], 1)
                h, c, doc, pos = h[~flagged], c[~flagged], doc[~flagged], pos[~flagged]
            n = len(h)
            if not n:
                continue
            new_h, new_c = np.ones(n, bool), np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_h[0] = h[0] != last[0]
                new_c[0] = new_h[0] or c[0] != last[1]
            heads = np.flatnonzero(new_c)
            of = np.searchsorted(heads, np.arange(n), side="right") - 1
            first_doc = np.where(of >= 0, doc[heads[np.maximum(of, 0)]] if len(heads) else 0, last[2] if last else 0)
            first_pos = np.where(of >= 0, pos[heads[np.maximum(of, 0)]] if len(heads) else 0, last[3] if last else 0)
            again = ~new_c & ~((doc == first_doc) & (pos == first_pos))
            if again.any():
                yield out(h[again], doc[again], pos[again], 1)
            if not len(heads):
                continue
            gram = np.cumsum(new_h)[heads]  # 0: the gram of the batch before
            count = np.bincount(gram, minlength=int(gram[-1]) + 1)
            if gram[0] == 0 and held is not None:
                yield out(*(np.array([x]) for x in held), 0)
                held, several = None, True
            if gram[0] == 0:
                count[0] += 2  # that gram has several now
            give = count[gram] > 1
            if give.any():
                yield out(h[heads[give]], doc[heads[give]], pos[heads[give]], 0)
            x = heads[-1]
            last, several = (h[x], c[x], doc[x], pos[x]), bool(give[-1])
            held = None if several else (h[x], doc[x], pos[x])

    def out(h, doc, pos, state):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(pos), pa.array(np.full(len(h), state, np.int32))], schema=schema)

    return anchors.repartition("h").sortWithinPartitions("h", "c", "doc", "pos").mapInArrow(run, "h long, doc long, pos long, state int")


def runs_of(docs: DataFrame, open_units: DataFrame, buckets: int, key: str, text: str) -> DataFrame:
    """bucket, kind, run, and for kind 2 doc, start, end: front-coded runs of suffixes (0), string hashes (1), matches found in the task (2)."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).join(open_units, "doc").select("doc", "text", "units")
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        held, size, hot = [], 0, []
        for part in sliced(batches):
            data, offsets = flat(part.column("text"))
            a = Anchors(data, offsets)
            listed = part.column("units")
            each = listed.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
            pos, is_hot = each.field("pos").to_numpy(), each.field("hot").to_numpy(zero_copy_only=False)
            where = np.minimum(np.searchsorted(a.at, offsets[:-1][row] + pos), max(0, len(a.at) - 1))
            if not len(a.at):
                continue
            right = (a.at[where] == offsets[:-1][row] + pos) & (a.row[where] == row)  # false for other rows of the same id
            where, is_hot = where[right], is_hot[right]
            doc = ids_of(part.column("doc"))
            raw = data.tobytes()
            for x in where[~is_hot].tolist():
                at, low, high, r = int(a.at[x]), int(a.low[x]), int(a.high[x]), int(a.row[x])
                held.append((raw[at : high + LENGTH], raw[low:at], int(doc[r]), at - int(offsets[r]), at - high, int(a.hash[x])))
                size += high + LENGTH - low + 100
            if is_hot.any():
                x = where[is_hot]
                n = a.high[x] - a.low[x] + 1
                q = np.repeat(a.low[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                r = np.repeat(a.row[x], n)
                hot.append(np.column_stack([a.hashes(q, LENGTH).view(np.int64), np.repeat(a.hash[x], n).view(np.int64), doc[r], q - offsets[r]]))
            if size > RUN_BYTES or sum(map(len, hot)) > 1 << 20:
                yield from flush(held, hot)
                held, size, hot = [], 0, []
        yield from flush(held, hot)

    def flush(held, hot):
        held.sort()
        of: dict[int, list] = {}
        for u in held:
            of.setdefault(u[5] % buckets, []).append(u)
        for bucket, units in of.items():
            yield row_of(bucket, 0, packed(units))
        if hot:
            x = np.concatenate(hot)
            stay, matched = earliest([x[:, 0], x[:, 1]], x[:, 2], x[:, 3])
            yield from matches(x[matched, 2], x[matched, 3])
            x = x[stay]
            own = (x[:, 0].view(np.uint64) % U64(buckets)).astype(np.int64)
            for bucket in np.unique(own).tolist():
                yield row_of(bucket, 1, np.ascontiguousarray(x[own == bucket]).tobytes())

    def row_of(bucket, kind, run):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([run], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], schema=schema)

    def matches(doc, start):
        doc, start, end = spans(doc, start)
        n = len(doc)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array((start % buckets).astype(np.int32)), pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.binary()), pa.array(doc), pa.array(start), pa.array(end)], schema=schema)

    return rows.mapInArrow(run, "bucket int, kind int, run binary, doc long, start long, end long")


def packed(units: list) -> bytes:
    """A front-coded run: the number of units, heads, doc ids, positions, (left length, distance) pairs, rests, lefts."""
    heads, rests = front_coded([u[0] for u in units])
    numbers = np.array([len(units), len(rests)], np.int64).tobytes()
    doc, pos = np.array([u[2] for u in units], np.int64).tobytes(), np.array([u[3] for u in units], np.int64).tobytes()
    small = bytes(x for u in units for x in (len(u[1]), u[4]))
    return numbers + heads + doc + pos + small + rests + b"".join(u[1] for u in units)


class Run:
    def __init__(self, raw: bytes):
        n, more = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        self.heads = raw[at : at + 2 * n]
        at += 2 * n
        self.doc = np.frombuffer(raw[at : at + 8 * n], np.int64)
        at += 8 * n
        self.pos = np.frombuffer(raw[at : at + 8 * n], np.int64)
        at += 8 * n
        small = np.frombuffer(raw[at : at + 2 * n], np.uint8).reshape(n, 2).astype(np.int64)
        at += 2 * n
        self.before, self.nearest = small[:, 0], small[:, 1]
        self.rests = raw[at : at + more]
        self.lefts = raw[at + more :]
        self.left_at = np.cumsum(self.before) - self.before

    def __iter__(self):
        return decoded(self.heads, self.rests)

    def left_of(self, i: int) -> bytes:
        """The bytes before the anchor of unit i."""
        begin = int(self.left_at[i])
        return self.lefts[begin : begin + int(self.before[i])]


def earliest(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys: the place of the earliest (doc, start), and the places of the later ones."""
    order = np.lexsort((start, doc, *keys))
    first = np.ones(len(order), bool)
    first[1:] = False
    for k in keys:
        first[1:] |= k[order][1:] != k[order][:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    later = ~first & ~((doc[order] == doc[head]) & (start[order] == start[head]))
    return order[first], order[later]


def spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings at (doc, start) as maximal runs of consecutive starts: doc, start, end of the covered bytes."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], start[at], start[last] + LENGTH


def merge_bucket(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of all strings served by the runs' anchors that an earlier one equals.

    A string reaches `d` bytes to the left of its anchor. Two of them are equal if
    the suffixes have LENGTH - d bytes in common, which the merge tells, and the
    bytes before the anchors d, which the sorted left contexts tell. Nothing is hashed.
    """
    group: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, int]] = []
    at = [0] * len(runs)
    for r, shared in merged([iter(x) for x in runs]):
        if shared < GRAM:
            if len(group) > 1:
                found += group
            group = []
        group.append((r, at[r], shared if group else 0))
        at[r] += 1
    if len(group) > 1:
        found += group
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.array([f[2] for f in found], np.int64)
    doc = np.array([runs[r].doc[i] for r, i, _ in found], np.int64)
    pos = np.array([runs[r].pos[i] for r, i, _ in found], np.int64)
    left = np.array([runs[r].before[i] for r, i, _ in found], np.int64)
    near = np.array([runs[r].nearest[i] for r, i, _ in found], np.int64)
    before = [runs[r].left_of(i) for r, i, _ in found]
    order, common_left = sorted_lefts(before)
    d = np.arange(SPAN)
    # the number of breaks up to a unit names its run of equal neighbours, for each reach d
    right_of = np.cumsum(shared[:, None] < LENGTH - d[None, :], axis=0, dtype=np.int32)
    left_of = np.empty_like(right_of)
    left_of[order] = np.cumsum(common_left[:, None] < d[None, :], axis=0, dtype=np.int32)
    unit, reach = np.nonzero((d[None, :] >= near[:, None]) & (d[None, :] <= left[:, None]))
    same = (right_of[unit, reach].astype(np.int64) << 32) | left_of[unit, reach]
    start = pos[unit] - reach
    _, later = earliest([reach, same], doc[unit], start)
    return doc[unit][later], start[later]


def sorted_lefts(before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the contexts by their bytes from the last to the first, and the bytes that each has in common with the one before."""
    turned = [b[::-1] for b in before]
    order = np.array(sorted(range(len(turned)), key=turned.__getitem__), np.int64)
    shared, last = np.zeros(len(order), np.int64), b""
    for k, i in enumerate(order.tolist()):
        shared[k], last = common(last, turned[i], 0), turned[i]
    return order, shared


def match(runs: DataFrame) -> DataFrame:
    """doc, start, end of matched strings."""

    def run(batches):
        bucket, kept, hashes = None, [], []

        def close():
            if kept:
                yield from given(*merge_bucket([Run(r) for r in kept]))
            if hashes:
                x = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 4) for r in hashes])
                later = earliest([x[:, 0], x[:, 1]], x[:, 2], x[:, 3])[1]
                yield from given(x[later, 2], x[later, 3])

        for b in batches:
            for i in range(b.num_rows):
                own, kind = b.column("bucket")[i].as_py(), b.column("kind")[i].as_py()
                if own != bucket:
                    yield from close()
                    bucket, kept, hashes = own, [], []
                if kind == 2:
                    yield pa.RecordBatch.from_arrays([b.column(n).slice(i, 1) for n in ("doc", "start", "end")], names=["doc", "start", "end"])
                else:
                    (hashes if kind else kept).append(b.column("run")[i].as_py())
        yield from close()

    def given(doc, start):
        doc, start, end = spans(doc, start)
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end)], names=["doc", "start", "end"])

    return runs.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "doc long, start long, end long")


def marked_hot(left: DataFrame, hot: DataFrame) -> DataFrame:
    """left with a column is_hot. Both sides are dealt by a salt too, so that no task gathers all anchors of a gram."""
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left").drop("salt")


def covered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, marks: for each document with repeats its settled anchors (start, -1) and matched runs (start, end)."""
    prepare(docs.sparkSession)
    files = file_count(docs)
    settled = written(settle(anchor_rows(docs, key, text)), "anchors", files=files)
    left = settled.where("state = 0").select("h", "doc", "pos")
    hot = left.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("is_hot"))
    total = left.count()
    marks = settled.where("state = 1").select("doc", F.col("pos").alias("start"), F.lit(-1).cast("long").alias("end"))
    if total:
        units = marked_hot(left, hot).groupBy("doc").agg(F.collect_list(F.struct("pos", F.coalesce("is_hot", F.lit(False)).alias("hot"))).alias("units"))
        matched = match(runs_of(docs, units, max(1, total // BUCKET_UNITS), key, text))
        marks = marks.union(written(matched, "matches", files=files))
    return marks.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("marks"))


def cut(docs: DataFrame, key: str, text: str, columns: list[str], make, schema) -> DataFrame:
    """docs joined with what is covered; make(batch part, data, offsets, removed mask) gives the output columns."""
    own, listed = fresh(docs, "__doc", "__marks")
    marks = covered(docs, key, text).select(F.col("doc").alias(own), F.col("marks").alias(listed))
    rows = docs.join(marks, docs[key] == marks[own], "left").select(*columns, listed)

    def run(batches):
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            change = np.zeros(len(data) + 1, np.int64)
            marked = part.column(listed)
            if marked.null_count < part.num_rows:
                a = Anchors(data, offsets)
                each = marked.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(list_offsets(marked)))
                start, end = each.field("start").to_numpy(), each.field("end").to_numpy()
                first, last = offsets[:-1][row], offsets[1:][row]
                whole = end < 0
                if whole.any() and len(a.at):
                    wanted = first[whole] + start[whole]
                    x = np.minimum(np.searchsorted(a.at, wanted), len(a.at) - 1)
                    x = x[(a.at[x] == wanted) & (a.row[x] == row[whole])]
                    np.add.at(change, a.low[x], 1)
                    np.add.at(change, a.high[x] + LENGTH, -1)
                inside = ~whole & (first + end <= last)
                np.add.at(change, (first + start)[inside], 1)
                np.add.at(change, (first + end)[inside], -1)
            yield make(part, data, offsets, np.cumsum(change[:-1]) > 0)

    return rows.mapInArrow(run, schema)


def list_offsets(column: pa.ListArray) -> np.ndarray:
    """Offsets of a list column's rows into its flattened values; null rows are empty."""
    n = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(n)])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def make(part, data, offsets, removed):
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[offsets])
        head = removed.copy()
        head[1:] &= ~removed[:-1]
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        head[begins] = removed[begins]
        n_spans = np.diff(np.concatenate([[0], np.cumsum(head)])[offsets])
        kept = data[~removed].tobytes()
        ends = offsets - np.concatenate([[0], np.cumsum(n_removed)])
        sums = [sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans), pa.array(sums)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(docs, key, text, [key, text], make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated bytes cut out of the text, all columns kept; what is left of a split character goes."""
    names, schema = list(docs.columns), docs.schema
    place = names.index(text)

    def make(part, data, offsets, removed):
        columns = [part.column(i) for i in range(len(names))]
        texts = [None if old is None else data[a:b][~removed[a:b]].tobytes().decode("utf-8", "ignore") for old, a, b in zip(part.column(text).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return cut(docs, key, text, names, make, schema)
