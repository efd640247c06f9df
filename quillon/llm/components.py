"""Connected components of an edge table, by alternating large and small stars, and helpers for grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b), a < b."""
    pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        pairs = pairs.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
    # dealt by a salt too: the centre of a large star has an edge to each of its members
    salted = least.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    met = pairs.join(salted, (pairs.u == salted.u2) & (pairs.salt == salted.salt2))
    out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else met.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u2").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, files: int | None = None, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node. Each round is written to the shared folder, in so many files at most."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges", files=files)
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, last = state, now
        now = written(_star(_star(now, True), False), "edges", files=files)
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (integers, no nulls), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in keys])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and not (k[lo] == last).all():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index connected with each of n indices, by the pairs (left, right)."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root
