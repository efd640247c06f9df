"""Operator 2: n-gram Jaccard join with Bayesian candidate pruning.

Similarity: Jaccard of the sets of 5-word shingles (words as in textops; a text
of fewer words, but not none, has one shingle); linked from 4/5 on.

1. One pass gives each document a 128-bit key of its shingle set and 120 MinHash
   values of one byte. Documents of equal sets are one *text* with a number of
   copies, represented by the least id; all further work is on texts.
2. 24 bands of 5 values name buckets. Buckets of one text go, and of buckets with
   the same members one stays. A large bucket is split into blocks, and a task
   sees two blocks. For its pairs the MinHash values are compared step by step;
   with m of n equal, a pair is dropped once the posterior (uniform prior)
   probability of similarity >= 4/5 is below TOLERANCE. Of the pairs that survive
   all 120 only a spanning forest is passed on.
3. The forest's components hold all links. The members' shingle sets are read
   again and sent to their component (in blocks, where it is large); all pairs are
   pruned as before, and the survivors verified by exact intersection counts. Each
   task returns, for each member, the weight of its links and one forest edge.
4. Components of the verified edges are the classes.

No pair is ever a row: a link between two texts is counted where both meet.
Every link counts; nothing is capped. The pairs of a group of *different* near
copies are compared in blocks, spread over tasks; copies add no pairs.

Result: one row per document: doc_id, class_id (least id of the class), n_links
(other documents at 4/5 or more, copies included), n_copies (documents with the
same shingle set, itself included), n_shingles. Null, empty and wordless texts
have class_id = doc_id and no links. Rows that share a doc_id are one document
in classes. A null doc_id takes no part and has a null class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, file_count, fresh, prepare, written
from .components import components, groups, roots_of
from .textops import U64, flat, mix, shingles_of, sliced, words_of

BANDS, ROWS = 24, 5
VALUES = BANDS * ROWS
SHINGLE_WORDS = 5
OVER, UNDER = 4, 5  # linked if |A and B| * UNDER >= |A or B| * OVER
TOLERANCE = 1e-4
STEP = 20  # MinHash values between two looks at the posterior
BUCKET_BLOCK = 512
COMPONENT_BLOCK = 256
MOST_BROADCAST = 16 << 20  # bytes of members (ROW_BYTES each) that may be broadcast to find their texts again
ROW_BYTES = 100  # six integers of a member, and its place in the hash table
SALTS = 16  # parts of a bucket's members when they are told that it is to be compared


def permutations() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    return (x[:VALUES] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[VALUES:] >> U64(32)).astype(np.uint32)


_A, _B = permutations()


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """VALUES bytes for each run of shingle hashes that begins at starts."""
    x = (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(starts), VALUES), np.uint8)
    for k in range(VALUES):
        least = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        out[:, k] = (mix(least.astype(np.uint64) + U64(k << 32)) & U64(255)).astype(np.uint8)
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """Each band's values as one integer."""
    out = np.zeros((len(sig), BANDS), np.int64)
    for r in range(ROWS):
        out |= sig[:, r::ROWS].astype(np.int64) << (8 * r)
    return out


def unpacked(bands: np.ndarray) -> np.ndarray:
    out = np.empty((len(bands), VALUES), np.uint8)
    for r in range(ROWS):
        out[:, r::ROWS] = (bands >> (8 * r)) & 255
    return out


def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among n that leave the posterior of similarity >= OVER / UNDER at tolerance or more.

    A pair of similarity s agrees in a value with probability s + (1 - s) / 256;
    under a uniform prior the posterior's upper tail is a binomial sum.
    """
    from math import comb

    p = OVER / UNDER + (1 - OVER / UNDER) / 256
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


_LEAST = {n: least_matches(n) for n in range(STEP, VALUES + 1, STEP)}


def surviving(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in a, j in b) that no look at the posterior drops; within a (i < j) if b is None."""
    own = b is None
    b = a if own else b
    same = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        same += a[:, k, None] == b[None, :, k]
    alive = same >= _LEAST[STEP]
    if own:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    m = same[i, j].astype(np.int64)
    for n in range(2 * STEP, VALUES + 1, STEP):
        if not len(i):
            break
        part = slice(n - STEP, n)
        for lo in range(0, len(i), 1 << 16):
            hi = lo + (1 << 16)
            m[lo:hi] += (a[i[lo:hi], part] == b[j[lo:hi], part]).sum(1)
        keep = m >= _LEAST[n]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sets (sorted distinct hashes) are linked, by exact counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    # a pair of sizes too far apart can't reach the threshold
    fits = np.minimum(sizes[i], sizes[j]) * UNDER >= np.maximum(sizes[i], sizes[j]) * OVER
    out = np.zeros(len(i), bool)
    if fits.sum() <= 4 * len(sets):
        for x in np.flatnonzero(fits).tolist():
            s, t = sets[i[x]], sets[j[x]]
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            out[x] = both * UNDER >= (len(s) + len(t) - both) * OVER
        return out
    # many pairs: count through products of incidence matrices over the shingles that two sets or more hold
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            x = np.zeros((len(sets), width), np.float32)
            x[rows[lo:hi], column[lo:hi] % width] = 1
            both += x @ x.T
    got = both[i, j].astype(np.int64)
    return fits & (got * UNDER >= (sizes[i] + sizes[j] - got) * OVER)


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's key), bands; the last three null without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            row, h = shingles_of(words_of(data, offsets), SHINGLE_WORDS)
            n = np.bincount(row, minlength=part.num_rows)
            full = np.flatnonzero(n)
            starts = np.searchsorted(row, full)
            k1, k2 = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            if len(full):
                k1[full], k2[full] = set_keys(h, starts)
            listed = listed_bands(h, starts, n)
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), listed], schema=schema)

    return docs.select(key, text).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def listed_bands(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """The packed MinHash values of each row of n shingles; none for rows without."""
    bands = packed(signatures(h, starts)) if len(starts) else np.zeros((0, BANDS), np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))


def set_keys(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of distinct hashes, whatever their order."""
    return tuple(np.add.reduceat(mix(h ^ U64(c)), starts).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def bucket_rows(texts: DataFrame) -> DataFrame:
    """Members of the buckets to be compared: pos, key, n, rep, bands."""
    slots = texts.select("rep", F.posexplode("bands").alias("pos", "key"))
    buckets = slots.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    # equal members: equal number and equal sum of their hashes; the first such bucket stays
    once = buckets.groupBy("n", "x").agg(F.min(F.struct("pos", "key")).alias("b")).select(F.col("b.pos").alias("pos"), F.col("b.key").alias("key"), "n")
    # dealt by a salt too, so that no task gathers all members of a bucket
    once = once.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slots = slots.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(SALTS)).cast("int"))
    return slots.join(once, ["pos", "key", "salt"]).drop("salt").join(texts.select("rep", "bands"), "rep")


def in_blocks(rows: DataFrame, n: str, size: int) -> DataFrame:
    """Each row once for every pair (bi, bj) of blocks of its group that holds it; `own` tells the row's block."""
    parts = F.ceil(F.col(n) / size).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), parts).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("parts", "other")


def two_blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Row numbers of the two blocks of a group; the second is None where the group compares one block with itself."""
    own, bi, bj = (t.column(n).to_numpy() for n in ("own", "bi", "bj"))
    return (np.arange(len(own)), None) if bi[0] == bj[0] else (np.flatnonzero(own == bi[0]), np.flatnonzero(own == bj[0]))


def pairs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of a group, as row numbers."""
    sig = unpacked(bands_of(t))
    a, b = two_blocks(t)
    if b is None:
        return surviving(sig, None)
    i, j = surviving(sig[a], sig[b])
    return a[i], b[j]


def bands_of(t: pa.Table) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy().reshape(-1, BANDS) for c in t.column("bands").chunks])


def candidate_edges(texts: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the surviving pairs of each bucket."""

    def run(batches):
        a, b = [], []
        for t in groups(batches, ["pos", "key", "bi", "bj"]):
            if t.num_rows > 1:
                rep = t.column("rep").to_numpy()
                root = roots_of(len(rep), *pairs_of(t))
                at = np.flatnonzero(root != np.arange(len(rep)))
                a.append(rep[root[at]])
                b.append(rep[at])
                if len(a) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    keys = ["pos", "key", "bi", "bj"]
    rows = in_blocks(bucket_rows(texts), "n", BUCKET_BLOCK).select("rep", "bands", "own", *keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def with_sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """members (rep, k1, k2, ...; integers alone) with the shingle set and the MinHash values of each, made from docs again."""
    small = members.limit(MOST_BROADCAST // ROW_BYTES + 1).count() * ROW_BYTES <= MOST_BROADCAST
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(F.broadcast(members) if small else members, "rep")
    names = [x for x in rows.columns if x != "text"]

    def run(batches):
        for part in sliced(batches):
            data, offsets = flat(part.column("text"))
            row, h = shingles_of(words_of(data, offsets), SHINGLE_WORDS)
            full, starts = np.unique(row, return_index=True)
            right = np.zeros(part.num_rows, bool)
            if len(full):
                k1, k2 = set_keys(h, starts)
                right[full] = (part.column("k1").to_numpy()[full] == k1) & (part.column("k2").to_numpy()[full] == k2)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            bands = listed_bands(h, starts, np.bincount(row, minlength=part.num_rows)) if len(full) else pa.nulls(part.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), bands, sets], names=[*names, "bands", "shingles"]).filter(pa.array(right))

    longs = T.ArrayType(T.LongType())
    return rows.mapInArrow(run, rows.drop("text").schema.add("bands", longs).add("shingles", longs))


def verified_links(members: DataFrame) -> DataFrame:
    """rep, links (weight of the linked texts that it met), root: one row per member and task that it met."""
    keys = ["component", "bi", "bj"]

    def run(batches):
        for t in groups(batches, keys):
            rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
            i, j = pairs_of(t)
            if len(i):
                sets = [x.values.to_numpy().view(np.uint64) for c in t.column("shingles").chunks for x in c]
                good = verified(sets, i, j)
                i, j = i[good], j[good]
            links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            root = roots_of(len(rep), i, j)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(rep[root])], names=["rep", "links", "root"])

    rows = in_blocks(members, "n", COMPONENT_BLOCK).select("rep", "copies", "bands", "shingles", "own", *keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, root long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The result described above."""
    prepare(docs.sparkSession)
    files = file_count(docs)
    profiles = written(profile(docs, key, text), "profiles", files=files)
    counted = profiles.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = written(counted.select(F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands"), "copies", "k1", "k2"), "texts", files=files)
    found = components(candidate_edges(texts), max(1, files // 4))
    found = written(found.withColumnRenamed("node", "rep"), "components", files=max(1, files // 4))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = written(found.join(sizes, "component").join(texts.drop("bands"), "rep"), "members", files=max(1, files // 4))
    links = written(verified_links(with_sets(docs, members, key, text)), "links", files=files)
    discard(found)
    discard(members)
    linked = components(links.select(F.col("root").alias("a"), F.col("rep").alias("b")), max(1, files // 4)).withColumnRenamed("node", "rep").withColumnRenamed("component", "class_id")
    weight = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_text = texts.select("rep", "copies", "k1", "k2").join(linked, "rep", "left").join(weight, "rep", "left")
    of_text = of_text.select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = profiles.select("doc_id", "n_shingles", "k1", "k2").withColumn("has", F.col("n_shingles") > 0)
    out = out.join(of_text.withColumn("has", F.lit(True)), ["k1", "k2", "has"], "left")
    named = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), "n_shingles")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the least id of each class, all columns kept."""
    (name,) = fresh(docs, "__later")
    later = classes(docs, key, text).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, docs[key].eqNullSafe(later[name]), "left_anti")
