"""Operator 4: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where the content says so, so equal
passages in different documents give equal chunks. A chunk is encoded once and
its ids are kept in a bounded cache of the worker. Chunk edges are not token
edges: of each chunk only the core between two *certain* edges is kept. A join is
the text between the cores of two chunks. It is encoded again together with the
last piece of the core before and the first piece of the core behind, and the ids
must begin and end as those of these pieces do; where they don't, the text is
encoded whole, as what a join that grows on both sides comes to.

An edge is certain where a letter or digit is followed by one space and another
letter or digit: whatever stands around, the byte-level pre-tokeniser ends a
piece before that space and begins one with it, and pieces are merged
independently. So the first comparison agrees for the vocabularies accepted here.

Null texts count as empty (no ids). Repeated rows are encoded row by row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .textops import flat, sliced

# Fixed value: the pre-tokeniser's pattern of byte-level BPE files with use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK_BITS = 9  # mean chunk: 512 bytes
CACHE_BYTES = 32 << 20  # text and ids held by one generation of a worker's cache


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """ids of a text, as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte = byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        plain = {k: v for k, v in model.get("vocab", {}).items() if k not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        same = (
            model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and all(set(k) <= byte.keys() for k in plain)
            and not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        )
        ranked = [plain.get(a + b, -1) for a, b in merges]
        if not same or ranked != sorted(set(ranked)) or len(ranked) + 256 != len(plain):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        if any(_CERTAIN.search(x) for x in self.special):
            raise ValueError(f"{path}: a special token that a certain edge would cut")
        import tiktoken

        ranks = {bytes(byte[c] for c in k): v for k, v in plain.items()}
        self.engine = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.decode_bytes = self.engine.decode_bytes

    def whole(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def gear_table() -> np.ndarray:
    """256 pseudo-random words by a linear congruential rule."""
    x, out = 88172645463325252, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 32)
    return np.array(out, dtype=np.uint32)


_GEAR = gear_table()


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Offsets of chunk edges: where the hash of the last 32 bytes has `bits` low zeros, moved on to the next character."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < len(h):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    # the high bits depend on all 32 bytes, the low ones on few
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    for _ in range(3):
        at = at[at < len(data)]
        at = at + ((data[at] & 0xC0) == 0x80)
    return np.unique(at[at < len(data)])


_NONE = np.zeros(0, np.uint32)
CONTEXT = 24  # characters of a piece beside a join that are compared
_CERTAIN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def last_certain(text: str) -> int:
    """Offset of the last certain edge, or -1."""
    at = text.rfind(" ", 1, len(text) - 1)
    while at > 0 and not (text[at - 1].isalnum() and text[at + 1].isalnum()):
        at = text.rfind(" ", 1, at)
    return at if at > 0 else -1


class ChunkEncoder:
    """Encodes texts by reused chunks; exact. `hits` and `misses` count chunks and joins, `repairs` joins that didn't agree."""

    def __init__(self, engine: Codec, most: int = CACHE_BYTES):
        self.engine, self.most, self.size = engine, most, 0
        self.young: dict = {}
        self.old: dict = {}
        self.hits = self.misses = self.repairs = 0

    def _kept(self, key, make):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                self.misses += 1
                found = make(key)
            else:
                self.hits += 1
            self.young[key] = found
            self.size += 400 + 4 * (len(key) if isinstance(key, bytes) else sum(map(len, key[1:])))
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
        else:
            self.hits += 1
        return found

    def _ids(self, text: str) -> tuple[np.ndarray, bytes]:
        ids = self.engine.whole(text)
        return ids, ",".join(map(str, ids.tolist())).encode()

    def _chunk(self, raw: bytes):
        """(head, core, tail, first, last): core is None where the chunk has no two certain edges; first and last are its outer pieces, or what of them lies within CONTEXT characters."""
        text = raw.decode()
        found = _CERTAIN.search(text)
        if found is None or (end := last_certain(text)) <= found.start():
            return text, None, "", "", ""
        begin = found.start()
        core = text[begin:end]
        first, last = _CERTAIN.search(core, 1), last_certain(core)
        first = core[: min(CONTEXT, first.start() if first else len(core))]
        last = core[max(last, len(core) - CONTEXT, 0) :]
        return text[:begin], self._ids(core), text[end:], first, last

    def _word(self, key):
        return self.engine.whole(key[1])

    def _join(self, key):
        """Ids of a join (before, text, behind), agreed with those of the pieces around it; None if they don't agree."""
        _, before, text, behind = key
        left, right = (self._kept((1, x), self._word) if x else _NONE for x in (before, behind))
        ids = self.engine.whole(before + text + behind)
        a, b = len(left), len(ids) - len(right)
        if a <= b and (ids[:a] == left).all() and (ids[b:] == right).all():
            return ids[a:b], ",".join(map(str, ids[a:b].tolist())).encode()
        self.repairs += 1
        return ()

    def pieces(self, raw: bytes, cuts) -> list[tuple[np.ndarray, bytes]]:
        """Ids of one text, in pieces, each as an array and as decimal text."""
        done: list[tuple[np.ndarray, bytes]] = []
        waiting, begin, before = "", 0, ""
        for end in [*cuts, len(raw)]:
            head, core, tail, first, last = self._kept(raw[begin:end], self._chunk)
            begin = end
            waiting += head
            if core is None:
                continue
            if waiting:
                done.append(self._kept((0, before, waiting, first), self._join))
            done.append(core)
            waiting, before = tail, last
        if waiting:
            done.append(self._kept((0, before, waiting, ""), self._join))
        return done if all(done) else [self._ids(raw.decode())]

    def encode_column(self, column) -> Iterator[tuple[bytes, list[tuple[np.ndarray, bytes]]]]:
        """(text as bytes, its pieces) for each row of an Arrow string column."""
        data, offsets = flat(column)
        if not len(data):
            yield from ((b"", []) for _ in range(len(column)))
            return
        cuts, raw = cut_points(data), data.tobytes()
        lows, highs = np.searchsorted(cuts, offsets[:-1], side="right"), np.searchsorted(cuts, offsets[1:], side="left")
        for row, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist())):
            begin, end = int(offsets[row]), int(offsets[row + 1])
            text = raw[begin:end]
            yield text, self.pieces(text, (cuts[lo:hi] - begin).tolist()) if text else []


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(codec(path))
    return _encoders[path]


def joined(pieces: list[tuple[np.ndarray, bytes]]) -> np.ndarray:
    return np.concatenate([x for x, _ in pieces]) if pieces else np.zeros(0, np.uint32)


def encode_documents(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with an added array<int> column of ids. Every other column stays."""
    prepare(docs.sparkSession)
    schema = docs.drop(into).schema.add(into, T.ArrayType(T.IntegerType()))
    names = [x for x in docs.columns if x != into]

    def run(batches):
        e = encoder(path)
        for part in sliced(batches, text):
            ids = [joined(p) for _, p in e.encode_column(part.column(text))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*names, into])

    return docs.select(*names).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """encoded with an added string column: the text of the ids, special ids included."""
    prepare(encoded.sparkSession)
    schema = encoded.drop(into).schema.add(into, "string")
    names = [x for x in encoded.columns if x != into]

    def run(batches):
        engine = codec(path)
        for batch in batches:
            texts = [engine.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, into])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes. One narrow pass, no shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        e = encoder(path)
        for part in sliced(batches, text):
            counts, id_sums, text_sums, sizes = [], [], [], []
            for raw, pieces in e.encode_column(part.column(text)):
                ids = joined(pieces)
                decoded = e.engine.decode_bytes(ids.tolist())
                counts.append(len(ids))
                id_sums.append(sha256(b",".join(x for _, x in pieces)).hexdigest())
                text_sums.append(sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
