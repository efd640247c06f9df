"""Operator 10: token ids in wavelet-matrix shards.

Documents are range-partitioned and sorted by doc_id; each task encodes its
range and writes shards of about SHARD_TOKENS ids through Spark's committer, so
any file system that Spark can write will do and a lost executor costs one task.

A shard is one row of the Parquet files: the ids as a wavelet matrix (one
bit-plane a bit of an id, most significant first; each level keeps the zeros
before the ones of the level above), rank directories, and the ids' documents.
From a shard alone: access(i), rank(symbol, i), count(symbol), select(symbol, k),
occurrences(symbol), and all ids at once. count_tokens() and find_token() look ids
up in all shards of a folder.

Null texts count as empty: the document has the end id alone. Rows with equal
doc_id stay in one shard sequence, ordered by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec
from .common import prepare, scratch_path
from .textops import sliced

SHARD_TOKENS = 2 << 20
END_ID = 2
BLOCK = 64  # bytes of a plane between two entries of its rank directory

SHARD_SCHEMA = "part int, seq int, n_tokens long, planes array<binary>, zeros array<long>, ranks array<binary>, doc_ids array<long>, lengths array<int>"


class WaveletMatrix:
    """Rank and select over a sequence of ids, held as packed bit-planes."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        x = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in reversed(range(max(1, top.bit_length()))):
            bit = (x & x.dtype.type(1 << level)) != 0
            plane = np.packbits(bit)
            planes.append(plane.tobytes())
            ranks.append(rank_directory(plane).tobytes())
            low = x.take(np.flatnonzero(~bit))  # several times as fast as a mask
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(bit))])
        return WaveletMatrix(len(ids), planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        plane, byte = self.planes[level], i >> 3
        block = byte // BLOCK
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * BLOCK : byte]).sum())
        return count + (int(plane[byte] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i ids."""
        if symbol >> len(self.zeros):
            return 0
        begin = 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, begin), self._ones(level, i)
            begin, i = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (begin - a, i - b)
        return i - begin

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) bit of a level that equals `one`: its block by the directory, then its byte, then its bit."""
        plane, ranks = self.planes[level], self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * (8 * BLOCK) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = plane[block * BLOCK : (block + 1) * BLOCK]
        bits = np.unpackbits(part) == one
        return block * BLOCK * 8 + int(np.flatnonzero(bits)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of symbol, or -1: down the levels to the symbol's run, and back up to its place."""
        if k < 0 or k >= self.count(symbol):
            return -1
        begin, depth = 0, len(self.zeros)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, begin)
            begin = zeros + ones if symbol >> (depth - 1 - level) & 1 else begin - ones
        i = begin + k
        for level in reversed(range(depth)):
            one = symbol >> (depth - 1 - level) & 1
            i = self._find(level, i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of symbol, in order."""
        begin, depth = 0, len(self.zeros)
        end = self.n
        if symbol >> depth:
            return np.zeros(0, np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, begin), self._ones(level, end)
            begin, end = (zeros + a, zeros + b) if symbol >> (depth - 1 - level) & 1 else (begin - a, end - b)
        at = np.arange(begin, end)
        for level in reversed(range(depth)):
            if not len(at):
                break
            one = symbol >> (depth - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n) == one
            at = np.flatnonzero(bits)[at - self.zeros[level] if one else at]
        return at

    def all(self) -> np.ndarray:
        """All ids, the levels undone from the last to the first."""
        x = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for back, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(x)
            above[np.flatnonzero(~bit)] = x[:zeros]
            above[np.flatnonzero(bit)] = x[zeros:] | x.dtype.type(1 << back)
            x = above
        return x


def rank_directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bytes (and before the end, where the last block is full)."""
    counts = np.bitwise_count(plane).astype(np.uint32)
    blocks = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK)) if len(counts) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shards of docs, in ascending key order, to a new folder."""
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        engine, part, seq = codec(tokenizer), TaskContext.get().partitionId(), 0
        ids, keys, held = [], [], 0

        def shard():
            m = WaveletMatrix.build(np.concatenate(ids))
            row = {"part": part, "seq": seq, "n_tokens": m.n, "planes": [x.tobytes() for x in m.planes], "zeros": m.zeros, "ranks": [x.tobytes() for x in m.ranks], "doc_ids": keys, "lengths": [len(x) for x in ids]}
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SCHEMA)

        for piece in sliced(batches, text):
            for one, whole in zip(piece.column(key).to_pylist(), piece.column(text).to_pylist()):
                ids.append(np.append(engine.whole(whole or ""), np.uint32(end_id)))
                keys.append(one)
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
                    ids, keys, held, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    ordered = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(key).sortWithinPartitions(key, text)
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


ARROW_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""
    prepare(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # ids before each part, then before each shard of a part: one row a shard, never one a document
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    within = sizes.withColumn("before", F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("before")).alias("before"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = _of_shards(r).all().astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64()), pa.array([r["part"]] * len(sums), pa.int32()), pa.array([r["seq"]] * len(sums), pa.int32())], names=["doc_id", "at", "n_tokens", "ids_crc32", "part", "seq"])

    rows = shards.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, seq int")
    return rows.join(F.broadcast(starts) if shard_count_is_small(starts) else starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _of_shards(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])


def count_tokens(spark: SparkSession, path: str, symbols: list[int]) -> DataFrame:
    """token_id, n: occurrences of each of a few ids in the files, by rank alone; nothing is decoded."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = _of_shards(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), pa.array([m.count(s) for s in symbols], pa.int64())], names=["token_id", "n"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("n_tokens", "planes", "zeros", "ranks")
    return shards.mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, symbol: int) -> DataFrame:
    """doc_id, at: the documents that hold an id, and its places in each, by select."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                at = _of_shards(r).occurrences(symbol)
                ends = np.cumsum(np.array(r["lengths"], np.int64))
                own = np.searchsorted(ends, at, side="right")
                ids = pa.array(r["doc_ids"], pa.int64()).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at - np.concatenate([[0], ends])[own])], names=["doc_id", "at"])

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(run, "doc_id long, at long")


def shard_count_is_small(starts: DataFrame, most: int = 200_000) -> bool:
    """Whether the table of shard starts (20 bytes a shard) may be broadcast; else it is joined by shuffle."""
    return starts.limit(most + 1).count() <= most


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as shards into the shared folder, and what the files say of each document."""
    path = scratch_path(spark, "token-shards")
    write_shards(docs, tokenizer, path)
    return read_documents(spark, path)
