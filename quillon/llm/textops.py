"""Vectorised byte and word operations over Arrow string columns.

Words are the maximal runs of ASCII letters, digits and non-ASCII bytes, after
lower-casing A-Z. A word's hash is a polynomial over its bytes (mod 2**64),
finished by a mixing step; all words of a slice are hashed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of text handled at once; bounds the temporary arrays of a slice (about 80 bytes a byte).
SLICE_BYTES = 1 << 20

_codes = np.arange(256, dtype=np.int64)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
WORD = ((_codes >= 48) & (_codes <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_codes >= 128)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and inverse base to the powers 0 to n - 1 (at least), kept between calls."""
    if len(_powers.get("base", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 3))
        for name, b in (("base", _BASE), ("inverse", _BASE_INVERSE)):
            x = np.full(size, b, dtype=U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["base"], _powers["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64, after splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """All words of a slice, in order."""

    hash: np.ndarray  # uint64
    row: np.ndarray  # index of the row in the slice
    start: np.ndarray  # byte offsets into the slice
    end: np.ndarray
    count: np.ndarray  # words of each row


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(U64), none, none, none, np.zeros(rows, np.int64))
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(span_hashes(LOWER[data], start, end), row, start, end, np.bincount(row, minlength=rows))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of data[start:end] for many non-empty spans."""
    base, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * base[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def shingles_of(words: Words, k: int = 5, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles as (row, hash), distinct and sorted by both unless `distinct` is false. A row with fewer than k words, but not none, has one shingle of all its words."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    odd = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)  # unrelated weights: with related ones, repeated words collide
    parts_row, parts_hash = [], []
    if n >= k:
        h = words.hash[: n - k + 1] * odd[0]
        for j in range(1, k):
            h = h + words.hash[j : n - k + 1 + j] * odd[j]
        whole = words.row[: n - k + 1] == words.row[k - 1 :]
        parts_row.append(words.row[: n - k + 1][whole])
        parts_hash.append(h[whole])
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(words.count)])[short]
        h = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = words.count[short] > j
            h[has] += words.hash[begin[has] + j] * odd[j]
        parts_row.append(short)
        parts_hash.append(h + words.count[short].astype(U64))
    row, h = np.concatenate(parts_row), mix(np.concatenate(parts_hash))
    if not distinct:
        return row, h
    return distinct_pairs(row, h)


def distinct_pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (row, h), sorted by both. One sort of single integers: the row above the high bits of h."""
    if not len(row):
        return row, h
    bits = U64(max(1, int(row.max()).bit_length()))
    packed = (row.astype(U64) << (U64(64) - bits)) | (h >> bits)
    order = np.argsort(packed)
    packed, row, h = packed[order], row[order], h[order]
    if ((packed[1:] == packed[:-1]) & (h[1:] < h[:-1])).any():  # equal but for the low bits
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]
