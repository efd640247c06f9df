"""Operator 9: nearest neighbours by inner product, with an adaptive dimension scan over probed lists.

1. Rows of equal vectors are one *vector* with its KEEP least ids: no answer can
   hold more of them, and queries of equal vectors share one search.
2. From a sample of at most SAMPLE vectors the driver fits centroids (at most
   MOST_LISTS). Where the square root of the number of vectors is larger, a second
   level is fitted on what the first leaves, shared by all its lists: a list is
   then a pair of centroids, and there are MOST_LISTS * MOST_SECOND at most. By
   comparing with brute force within the sample the driver sets the number of
   lists to probe for a recall of TARGET (up to CELL vectors: all lists). Every
   vector is put in a list.
3. Lists are packed into cells of about CELL vectors, larger lists split over
   several. A query goes once to each cell that holds a list it probes.
4. In a cell, vectors and queries are turned by one random rotation. Inner
   products grow by column blocks; after the first block each query's best few
   are completed and give a threshold, and after each block a candidate is dropped
   if its extrapolated product, plus Z standard errors of that estimate, stays
   below it. What survives is scored in double precision on original vectors.

Null vectors, zero vectors, vectors with null or non-finite components, with
another dimension than most, or with a null id take no part. Rows that share an
id and a vector are one; equal scores are ranked by id. Fewer candidates than
TOP give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_count, prepare, written
from .components import groups

TOP = 20
KEEP = TOP + 1  # a query's own id is among its answers and is taken out later
SAMPLE = 20_000
MOST_LISTS = 1024
MOST_SECOND = 256  # centroids of the second level
SCORES = 1 << 22  # scores of queries and lists held at once
TARGET = 0.97
CELL = 4096
BLOCK = 16  # dimensions
Z = 3.5
DENSE = 0.04  # share of pairs left above which a block is multiplied whole
EVERY = 20  # queries: ids divisible by this


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: rows that take part."""
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    out = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(good).where(F.coalesce(finite & nonzero, F.lit(False)))
    sizes = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return out.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def distinct_vectors(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """v (bytes), ids (KEEP least, sorted), asked (whether any of its ids is a query)."""

    def run(batches):
        for batch in batches:
            m = matrix(batch.column("v"), kind)
            ids = batch.column("id").to_numpy()
            raw = [x.tobytes() for x in m]
            of: dict[bytes, list[int]] = {}
            for i, b in enumerate(raw):
                of.setdefault(b, []).append(int(ids[i]))
            keys = list(of)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(set(of[b]))[:KEEP] for b in keys], pa.list_(pa.int64())), pa.array([any(x % EVERY == 0 for x in of[b]) for b in keys])], names=["v", "ids", "asked"])

    parts = rows.mapInArrow(run, "v binary, ids array<long>, asked boolean")
    # first by a part of the rows, then by vector alone, so that no task gathers all of a common vector's ids
    for keys in (["v", "salt"], ["v"]):
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64)))
        parts = parts.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, KEEP).alias("ids"), F.bool_or("asked").alias("asked"))
    return parts.select("v", "ids", "asked")


def matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) + kind.type(0)  # -0 becomes 0


def rows_of(column, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


@dataclass
class Lists:
    """List i is the pair of centroids divmod(i, len(second)); second holds zero alone where there is one level."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    second: np.ndarray
    sizes: np.ndarray | None = None  # vectors of each list

    @property
    def count(self) -> int:
        return len(self.centroids) * len(self.second)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: that of the nearest centroid, and of the nearest one of the second level to the rest."""
        x = x.astype(np.float64)
        own = nearest(x, self.centroids)
        return own * len(self.second) + nearest(x - self.centroids[own], self.second) if len(self.second) > 1 else own

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all lists' centres."""
        q = q.astype(np.float64)
        return ((q @ self.centroids.T)[:, :, None] + (q @ self.second.T)[:, None, :]).reshape(len(q), -1)

    def probed(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists that each query probes, best first: `probes`, or more until they hold KEEP vectors."""
        out = []
        for lo in range(0, len(q), step := max(1, SCORES // self.count)):
            for score in self.scores(q[lo : lo + step]):
                few = min(self.count, self.probes)
                best = np.argpartition(-score, few - 1)[:few]
                if self.sizes[best].sum() < KEEP:
                    best = np.argsort(-score, kind="stable")
                    best = best[: max(few, int(np.searchsorted(np.cumsum(self.sizes[best]), KEEP)) + 1)]
                best = best[self.sizes[best] > 0]
                out.append(best[np.argsort(-score[best], kind="stable")].astype(np.int32))
        return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own, half = np.empty(len(x), np.int64), (c**2).sum(1) / 2
    for lo in range(0, len(x), step := max(1, SCORES // len(c))):
        own[lo : lo + step] = (x[lo : lo + step] @ c.T - half).argmax(1)
    return own


def k_means(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        size, total_of = np.bincount(own, minlength=count), np.zeros_like(c)
        np.add.at(total_of, own, x)
        c[size > 0] = total_of[size > 0] / size[size > 0, None]
    return c


def fit(sample: np.ndarray, total: int, seed: int = 7) -> Lists:
    """Centroids by k-means, and the number of probes that TARGET takes within the sample."""
    rng = np.random.default_rng(seed)
    x, d = sample.astype(np.float64), sample.shape[1]
    wanted = max(1, int(total**0.5))
    c = k_means(x, min(MOST_LISTS, wanted, len(x)), rng)
    more = min(MOST_SECOND, -(-wanted // len(c)), len(x)) if wanted > MOST_LISTS else 1
    second = k_means(x - c[nearest(x, c)], more, rng) if more > 1 else np.zeros((1, d))
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    lists = Lists(c, rotation, 1, second)
    own, needed = lists.of(x), []
    q = x[rng.choice(len(x), min(300, len(x)), replace=False)]
    best = np.argpartition(-(q @ x.T), min(TOP, len(x) - 1), axis=1)[:, : TOP + 1]
    for lo in range(0, len(q), step := max(1, SCORES // lists.count)):
        for score, b in zip(lists.scores(q[lo : lo + step]), best[lo : lo + step]):
            needed.append(lists.count - np.searchsorted(np.sort(score), score[own[b]], side="right"))  # better lists
    lists.probes = lists.count if total <= CELL else int(min(lists.count, np.quantile(np.concatenate(needed), TARGET) + 2))
    return lists


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each list."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // CELL))
    cell = room = 0
    for i, n in enumerate(sizes.tolist()):
        if n > CELL:
            cell += 1 if room else 0
            first[i], room = cell, 0
            cell += int(parts[i])
        else:
            if room + n > CELL:
                cell, room = cell + 1, 0
            first[i] = cell
            room += n
    return first, parts


def scan_cell(x: np.ndarray, own: np.ndarray, q: np.ndarray, probed: list[np.ndarray], rotation: np.ndarray, lists: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: places of the surviving vectors in x, and their exact scores."""
    d, kept = x.shape[1], None
    xr, qr = (x @ rotation).astype(np.float32), (q @ rotation).astype(np.float32)
    allowed = np.zeros((len(q), lists), bool)
    for i, p in enumerate(probed):
        allowed[i, p] = True
    allowed = allowed[:, own]
    at = min(BLOCK, d)
    part = qr[:, :at] @ xr[:, :at].T
    xn, qn = np.linalg.norm(x, axis=1).astype(np.float32), np.linalg.norm(q, axis=1).astype(np.float32)

    slack = np.float32(1e-6) * qn * (xn.max() if len(xn) else np.float32(0))

    def kth_best(part: np.ndarray, among: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A score that KEEP vectors reach: the KEEP-th among those that look best so far."""
        few = min(KEEP + 11, len(x))
        if few < KEEP:
            return np.full(len(q), -np.inf, np.float32)
        guess = np.where(among, part, np.float32(-np.inf))
        best = np.argpartition(guess, len(x) - few, axis=1)[:, len(x) - few :]
        exact = np.where(np.take_along_axis(among, best, 1), np.einsum("qd,qkd->qk", qr, x[best]), np.float32(-np.inf))
        return np.sort(exact, axis=1)[:, -KEEP] - slack

    threshold = kth_best(part, allowed, xr)

    def margin(done: int) -> np.float32:
        """Z standard errors of an extrapolated product of unit vectors, and what single precision may lose."""
        return np.float32(Z * ((d - done) / (d * done)) ** 0.5 + 1e-5)

    alive = allowed & (part * np.float32(d / at) + (margin(at) * qn)[:, None] * xn >= threshold[:, None])
    # while many pairs are left, a block is one product of matrices; few are gathered one by one
    while at < d and alive.sum() > DENSE * alive.size:
        end = min(at + BLOCK, d)
        columns = np.flatnonzero(alive.any(0))
        part, alive, xr, own_xn = part[:, columns], alive[:, columns], xr[columns], xn[columns]
        part += qr[:, at:end] @ xr[:, at:end].T
        at = end
        threshold = np.maximum(threshold, kth_best(part, alive, xr))
        alive &= part * np.float32(d / at) + (margin(at) * qn)[:, None] * own_xn >= threshold[:, None]
        kept = columns if kept is None else kept[columns]
        xn = own_xn
    i, j = np.nonzero(alive)
    partial = part[i, j]
    while at < d and len(i):
        end = min(at + BLOCK, d)
        for lo in range(0, len(i), 1 << 17):
            s = slice(lo, lo + (1 << 17))
            partial[s] += np.einsum("pd,pd->p", qr[i[s], at:end], xr[j[s], at:end])
        at = end
        left = partial * np.float32(d / at) + margin(at) * qn[i] * xn[j] >= threshold[i]
        i, j, partial = i[left], j[left], partial[left]
    j = j if kept is None else kept[j]
    edges = np.searchsorted(i, np.arange(len(q) + 1))
    return [(j[a:b], np.einsum("kd,d->k", x[j[a:b]], q[n])) for n, (a, b) in enumerate(zip(edges, edges[1:]))]


def best_ids(score: np.ndarray, ids: list[list[int]]) -> tuple[list[float], list[int]]:
    """The KEEP best (score, id), larger scores first, ties by id."""
    if len(score) > KEEP:
        least = np.partition(score, -KEEP)[-KEEP]
        chosen = np.flatnonzero(score >= least)
    else:
        chosen = np.arange(len(score))
    pairs = sorted((-float(score[c]), x) for c in chosen.tolist() for x in ids[c])[:KEEP]
    return [-a for a, _ in pairs], [b for _, b in pairs]


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the TOP nearest found of each query."""
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind = np.dtype(np.float32 if element == "float" else np.float64)
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, key, vector)
    files = file_count(vectors)
    unique = written(distinct_vectors(rows, kind), "vectors", files=files)
    total = unique.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = unique.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
    lists = fit(np.frombuffer(b"".join(sample), kind).reshape(len(sample), -1), total)
    count = lists.count

    def assign(batches):
        for b in batches:
            own = lists.of(rows_of(b.column("v"), kind)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=[*b.schema.names, "list"])

    listed = written(unique.mapInArrow(assign, "v binary, ids array<long>, asked boolean, list int"), "lists", files=files)
    sizes = np.zeros(count, np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MOST_LISTS * MOST_SECOND rows
        sizes[r[0]] = r[1]
    lists.sizes = sizes
    first, parts = packed(sizes)
    out_type = "cell int, asking int, did long, ids array<long>, v binary, list int, probes array<int>"
    schema = pa.schema([("cell", pa.int32()), ("asking", pa.int32()), ("did", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("list", pa.int32()), ("probes", pa.list_(pa.int32()))])

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            did = np.array([x[0] for x in b.column("ids").to_pylist()], np.int64)
            own = b.column("list").to_numpy()
            cell = first[own] + (did * 2654435761 % 2**31) % parts[own]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(did), b.column("ids"), b.column("v"), b.column("list"), pa.nulls(n, pa.list_(pa.int32()))], schema=schema)
            asked = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
            for lo in range(0, len(asked), 256):
                some = asked[lo : lo + 256]
                raw = [b.column("v")[i].as_py() for i in some.tolist()]
                probed = lists.probed(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))
                out = [(int(c), int(did[i]), v, p) for i, v, p in zip(some.tolist(), raw, probed) for c in np.unique(np.concatenate([np.arange(first[x], first[x] + parts[x]) for x in p]))]
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array(np.ones(n, np.int32)), pa.array([o[1] for o in out], pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.binary()), pa.nulls(n, pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], schema=schema)

    def scan(batches):
        x = own = ids = None
        for t in groups(cut(batches), ["cell", "asking", "piece"]):
            if t.column("asking")[0].as_py() == 0:
                x, own, ids, cell = rows_of(t.column("v"), kind).astype(np.float64), t.column("list").to_numpy(), t.column("ids").to_pylist(), t.column("cell")[0].as_py()
                continue
            if x is None or cell != t.column("cell")[0].as_py():
                continue
            q = rows_of(t.column("v"), kind).astype(np.float64)
            dids, scores, found = t.column("did").to_pylist(), [], []
            for places, score in scan_cell(x, own, q, [np.array(p) for p in t.column("probes").to_pylist()], lists.rotation, count):
                s, f = best_ids(score, [ids[p] for p in places.tolist()])
                scores.append([-v for v in s])
                found.append(f)
            structs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)), pa.StructArray.from_arrays([pa.array([v for s in scores for v in s], pa.float64()), pa.array([v for f in found for v in f], pa.int64())], names=["s", "id"]))
            yield pa.RecordBatch.from_arrays([pa.array(dids, pa.int64()), structs], names=["did", "best"])

    dealt = listed.mapInArrow(deal, out_type).repartition("cell").sortWithinPartitions("cell", "asking", "did")
    found = dealt.mapInArrow(scan, "did long, best array<struct<s:double,id:long>>")
    # per task one list of at most KEEP a query and cell; merged in part before all of a query's lists meet
    merged = found.groupBy("did").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, KEEP).alias("best"))
    queries = rows.where(F.pmod(F.col("id"), F.lit(EVERY)) == 0).select(F.col("id").alias("query_id"), "v").distinct()

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([x.tobytes() for x in matrix(b.column("v"), kind)] if b.num_rows else [], pa.binary())], names=["query_id", "v"])

    asked = queries.mapInArrow(keyed, "query_id long, v binary").join(unique.where("asked").select("v", F.col("ids")[0].alias("did")), "v").select("query_id", "did")
    answers = asked.join(merged, "did").select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, TOP)).alias("pos", "b"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (F.lit(0.0) - F.col("b.s")).alias("score"))


def cut(batches, rows: int = 128):
    """Batches with a column `piece` that numbers runs of query rows, so that few queries are scanned at once."""
    for b in batches:
        asking = b.column("asking").to_numpy()
        piece = np.where(asking == 1, np.arange(b.num_rows) // rows, 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece)], names=[*b.schema.names, "piece"])
