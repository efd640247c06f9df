"""Operator 8: line dedup by an exact set-similarity join.

A line (text between line feeds) has as tokens its 5-word shingles; a line of
fewer words, but not none, has one. With shingle=1 its tokens are its words, the
second occurrence of a word another token than the first. A line goes if an earlier line (smaller
doc_id, or same document and smaller line number) has a Jaccard similarity of
4/5 or more with it; lines are judged on the input, not on what is left. Lines
without words stay.

1. Rarity: counts of all tokens of the corpus in a table of fixed size, so that
   its broadcast has a bound (a byte for each of 2**COUNT_BITS classes of hashes).
   A token is its class's magnitude and its hash, in one integer: tokens sort from
   rare to frequent. Any such order gives the same result; it decides the work.
2. Equal token sets are one *set* with its first line. Two sets of 4/5 share one
   of the first n - ceil(4n/5) + 1 tokens (prefix filter). Tokens in the
   prefixes of two sets or more are buckets; of buckets with equal members one
   stays, and large ones are split into blocks of which a task sees two.
3. The members' tokens are read again. In a bucket, pairs that pass the length
   and the positional filter are verified by exact intersection counts, and the
   later set of a match goes. No pair is ever a row.

Null and empty texts have no lines. Rows that share a doc_id count as one
document, lines of equal number as one line. Rows with a null doc_id
are left alone and not reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, file_count, fresh, plan_bytes, prepare, written
from .components import groups
from .neardup import OVER, SHINGLE_WORDS, UNDER, in_blocks, set_keys, two_blocks, verified
from .textops import U64, Words, distinct_pairs, flat, mix, shingles_of, sliced, words_of

COUNT_BITS = 20
COUNT_CHUNK = 1 << 14  # counters of a row between tasks
LEVEL_SHIFT = U64(58)
BLOCK = 512
RUN_PAIRS = 1 << 20  # pairs of a token and a set that a task packs at once
BUCKET_BYTES = 4 << 20  # text to a bucket of packed pairs, about
MOST_BUCKETS = 1 << 20
SIGN = -(2**63)  # flipped, it gives Spark's longs the order of unsigned tokens
SENT_BYTES = 7  # of a token's 8 that are sent for verifying; buckets and set keys use all
SENT_SHIFT = U64(64 - 8 * SENT_BYTES)


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of all lines of a slice (n + 1), their documents and their numbers in them."""
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], feeds[feeds + 1 < len(data)] + 1]))
    row = np.searchsorted(offsets, begin, side="right") - 1
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    return np.append(begin, len(data)), row, np.arange(len(begin)) - first[row]


def token_counts(docs: DataFrame, text: str, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """How many tokens of the corpus fall into each of 2**COUNT_BITS classes of hashes. A task sends its counters in packed chunks."""

    def run(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            _, h = hashed(words_of(data, offsets), shingle)
            total += np.bincount((h >> U64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            width = 4 if total.max() < 2**32 else 8
            raw = [c.astype(f"<u{width}").tobytes() for c in total.reshape(-1, COUNT_CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(raw, pa.binary())], names=["chunk", "raw"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("raw").to_pylist()):
                x = np.frombuffer(raw, f"<u{len(raw) // COUNT_CHUNK}").astype(np.int64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "raw"])

    chunks = (1 << COUNT_BITS) // COUNT_CHUNK
    got = docs.select(text).mapInArrow(run, "chunk long, raw binary").repartition(chunks, "chunk").mapInArrow(add, "chunk long, raw binary").collect()  # 2**COUNT_BITS integers
    out = np.zeros((chunks, COUNT_CHUNK), np.int64)
    for r in got:
        out[r["chunk"]] = np.frombuffer(r["raw"], np.int64)
    return out.ravel()


def hashed(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, or of all words with the number of their occurrence in the row."""
    if shingle > 1:
        return shingles_of(words, shingle, distinct=False)
    row, h = words.row, words.hash
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    place = np.arange(len(h))
    return row, mix(h + (place - np.maximum.accumulate(np.where(first, place, 0))).astype(U64) * U64(0x9E3779B97F4A7C15))


def levels(counts: np.ndarray) -> np.ndarray:
    """Magnitude of each class's count, 0 to 62 by half powers of two."""
    return np.minimum(62, 2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def tokens_of(data: np.ndarray, offsets: np.ndarray, level: np.ndarray, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(line, token) of all lines, sorted, without repeats."""
    row, h = hashed(words_of(data, offsets), shingle)
    token = (level[(h >> U64(64 - COUNT_BITS)).astype(np.int64)].astype(U64) << LEVEL_SHIFT) | (h & U64((1 << 58) - 1))
    return distinct_pairs(row, token)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * OVER + UNDER - 1) // UNDER + 1


def lines(docs: DataFrame, level: np.ndarray, buckets: int, key: str, text: str, shingle: int) -> DataFrame:
    """The sets of each slice with the first of their lines there: doc, line, n, k1, k2; for each document a row with line -1 whose n is its number of lines with words; and rows with line -2 whose run packs pairs (token, k1) of the sets' prefixes for the bucket n."""
    names = ["doc", "line", "n", "k1", "k2", "run"]

    def dealt(pairs):
        """Rows of packed pairs, one for each bucket."""
        x = np.concatenate(pairs)
        own = (mix(x[:, 0].view(np.uint64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        x, own = x[order], own[order]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        runs = [np.ascontiguousarray(x[a:b]).tobytes() for a, b in zip(heads, [*heads[1:], len(x)])]
        zero = np.zeros(len(heads), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero), pa.array(zero - 2), pa.array(own[heads]), pa.array(zero), pa.array(zero), pa.array(runs, pa.binary())], names=names)

    def run(batches):
        pairs, held = [], 0
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            ids = part.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False) if not part.column(key).null_count else None
            docs_of = np.array([-(2**63) if x is None else x for x in part.column(key).to_pylist()], np.int64) if ids is None else ids
            at, doc, number = line_offsets(data, offsets)
            line, token = tokens_of(data, at, level, shingle) if len(at) > 1 else (np.zeros(0, np.int64), np.zeros(0, U64))
            full, starts, n = np.unique(line, return_index=True, return_counts=True)
            k1, k2 = set_keys(token, starts) if len(full) else (np.zeros(0, np.int64),) * 2
            worded = np.bincount(doc[full], minlength=part.num_rows) if len(full) else np.zeros(part.num_rows, np.int64)
            # the first line of each set in this slice; documents needn't come in order
            order = np.lexsort((number[full], docs_of[doc[full]], k2, k1))
            a, b = k1[order], k2[order]
            keep = np.ones(len(order), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            chosen = order[keep]
            take = prefix_length(n[chosen])
            ends = np.cumsum(take)
            inner = np.repeat(starts[chosen] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)
            if len(inner):
                pairs.append(np.column_stack([token[inner].view(np.int64), np.repeat(k1[chosen], take)]))
                held += len(inner)
            yield pa.RecordBatch.from_arrays([pa.array(docs_of[doc[full[chosen]]]), pa.array(number[full[chosen]].astype(np.int64)), pa.array(n[chosen].astype(np.int64)), pa.array(k1[chosen]), pa.array(k2[chosen]), pa.nulls(len(chosen), pa.binary())], names=names)
            zero = np.zeros(part.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs_of), pa.array(zero - 1), pa.array(worded.astype(np.int64)), pa.array(zero), pa.array(zero), pa.nulls(part.num_rows, pa.binary())], names=names)
            if held > RUN_PAIRS:
                yield dealt(pairs)
                pairs, held = [], 0
        if pairs:
            yield dealt(pairs)

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "doc long, line long, n long, k1 long, k2 long, run binary")


def shared_prefixes(found: DataFrame, files: int | None = None) -> DataFrame:
    """token, rep (k1), size and x of the tokens that the prefixes of two sets or more have."""
    schema = pa.schema([("token", pa.int64()), ("rep", pa.int64()), ("size", pa.int64()), ("x", pa.int64())])

    def run(batches):
        """Rows of tokens that two sets or more have; x is a sum of the bucket's members."""
        own, runs = None, []
        for b in batches:
            for bucket, raw in zip(b.column("n").to_pylist(), b.column("run").to_pylist()):
                if bucket != own:
                    yield from shared_tokens(runs)
                    own, runs = bucket, []
                runs.append(raw)
        yield from shared_tokens(runs)

    def shared_tokens(runs):
        x = np.frombuffer(b"".join(runs), np.int64).reshape(-1, 2)
        order = np.lexsort((x[:, 1], x[:, 0])) if len(x) else np.zeros(0, np.int64)
        yield from full(x[order, 0], x[order, 1])

    def full(token, rep):
        if not len(token):
            return
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (rep[1:] != rep[:-1])
        token, rep = token[keep], rep[keep]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        x = np.add.reduceat(mix(rep.view(np.uint64)), start).view(np.int64)
        size, x = np.repeat(size, size), np.repeat(x, size)
        many = size > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(rep[many]), pa.array(size[many]), pa.array(x[many])], schema=schema)

    # one exchange of the prefixes, packed; sets that share no token with another leave here
    packed = found.where("line = -2").select("n", "run").repartition("n").sortWithinPartitions("n")
    return written(packed.mapInArrow(run, "token long, rep long, size long, x long"), "line-slots", files=files)


def members(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets of the buckets to be compared: token, size, rep (k1), k2, doc, line."""
    # the positional filter needs the first of a pair's common tokens, in the tokens' own order
    once = shared.groupBy("size", "x").agg(F.min(F.col("token").bitwiseXOR(F.lit(SIGN))).bitwiseXOR(F.lit(SIGN)).alias("token"))
    return shared.join(once, ["size", "x", "token"]).drop("x").join(sets.withColumnRenamed("k1", "rep"), "rep")


def with_tokens(docs: DataFrame, chosen: DataFrame, level: np.ndarray, key: str, text: str, shingle: int) -> DataFrame:
    """rep, k2, doc, line, tokens of the chosen sets, from their first lines."""
    of_doc = chosen.select("rep", "k2", "doc", "line").distinct().groupBy("doc").agg(F.collect_list(F.struct("line", "rep", "k2")).alias("wanted"))
    # by shuffle at every size: most documents hold some such line
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).join(of_doc.hint("merge"), "doc")
    schema = pa.schema([("rep", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("line", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for part in sliced(batches):
            data, offsets = flat(part.column("text"))
            if not len(data):
                continue
            at, doc, number = line_offsets(data, offsets)
            wanted = part.column("wanted")
            each, row = wanted.flatten(), np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            line, rep, k2 = (each.field(n).to_numpy() for n in ("line", "rep", "k2"))
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            there = line < (first[1:] - first[:-1])[row]  # false for other rows of the same id
            line, rep, k2, row = line[there], rep[there], k2[there], row[there]
            x = first[row] + line
            # only the wanted lines are cut into tokens
            length = at[x + 1] - at[x]
            ends = np.concatenate([[0], np.cumsum(length)])
            own = data[np.arange(ends[-1]) + np.repeat(at[x] - ends[:-1], length)]
            of, token = tokens_of(own, ends, level, shingle)
            full, starts = np.unique(of, return_index=True)
            if not len(full):
                continue
            a, b = set_keys(token, starts)
            right = np.zeros(len(x), bool)
            right[full] = (a == rep[full]) & (b == k2[full])
            ends = np.searchsorted(of, np.arange(len(x) + 1)).tolist()
            raw = sent(token)
            lists = pa.array([raw[SENT_BYTES * lo : SENT_BYTES * hi] for lo, hi in zip(ends, ends[1:])], pa.binary())
            ids = part.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(k2), pa.array(ids[row]), pa.array(line), lists], schema=schema).filter(pa.array(right))

    return rows.select("doc", "text", "wanted").mapInArrow(run, "rep long, k2 long, doc long, line long, tokens binary")


def sent(token: np.ndarray) -> bytes:
    """The upper bits of sorted tokens, SENT_BYTES each."""
    return (token >> SENT_SHIFT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES].tobytes()


def received(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SENT_BYTES, 8), np.uint8)
    out[:, :SENT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SENT_BYTES)
    return out.view("<u8").ravel()


def later_matches(rows: DataFrame) -> DataFrame:
    """(k1, k2) of sets that match an earlier one in some bucket."""
    keys = ["token", "bi", "bj"]

    def run(batches):
        k1, k2 = [], []
        for t in groups(batches, keys):
            if t.num_rows < 2:
                continue
            doc, line = t.column("doc").to_numpy(), t.column("line").to_numpy()
            token = t.column("token")[0].as_py()
            sets = [received(x) for x in t.column("tokens").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            place = np.array([np.searchsorted(s, U64(token & (2**64 - 1)) >> SENT_SHIFT) for s in sets], np.int64)
            a, b = two_blocks(t)
            own = b is None
            b = a if own else b
            x, y = n[a][:, None], n[b][None, :]
            fits = np.minimum(x, y) * UNDER >= np.maximum(x, y) * OVER
            left = np.minimum((n - place)[a][:, None], (n - place)[b][None, :])
            fits &= left * (OVER + UNDER) >= (x + y) * OVER  # positional: the common tokens from this one on must do
            if own:
                fits &= np.triu(np.ones(fits.shape, bool), 1)
            i, j = np.nonzero(fits)
            i, j = a[i], b[j]
            if len(i):
                good = verified(sets, i, j)
                good &= (doc[i] != doc[j]) | (line[i] != line[j])
                i, j = i[good], j[good]
                late = np.unique(np.where((doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j])), j, i))
                if len(late):
                    k1.append(t.column("rep").to_numpy()[late])
                    k2.append(t.column("k2").to_numpy()[late])
                    if len(k1) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2))], names=["k1", "k2"])
                        k1, k2 = [], []
        if k1:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2))], names=["k1", "k2"])

    rows = in_blocks(rows, "size", BLOCK).select("rep", "k2", "doc", "line", "tokens", "own", *keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "k1 long, k2 long").distinct()


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document with an id: doc_id, n_lines (those with words), kept (their numbers that stay, sorted). shingle: words of a token."""
    prepare(docs.sparkSession)
    files = file_count(docs)
    level = levels(token_counts(docs, text, shingle))
    buckets = min(MOST_BUCKETS, max(64, plan_bytes(docs) // BUCKET_BYTES))
    found = written(lines(docs, level, buckets, key, text, shingle), "lines", files=files)
    shared = shared_prefixes(found, files)
    rows = written(found.where("line >= -1").drop("run"), "line-firsts", files=max(1, files // 2))
    discard(found)  # the packed prefixes are the most of it
    found = rows
    sets = found.where("line >= 0").groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.min_by("line", "doc").alias("line"))
    sets = written(sets, "line-sets", files=max(1, files // 2))
    chosen = written(members(shared, sets), "line-buckets", files=max(1, files // 2))
    discard(shared)
    tokens = written(with_tokens(docs, chosen, level, key, text, shingle), "line-tokens", files=files)
    rows = chosen.select("token", "size", "rep", "k2").join(tokens, ["rep", "k2"])
    kept = sets.join(later_matches(rows), ["k1", "k2"], "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("kept"))
    each = found.where("line = -1").select("doc", F.col("n").alias("n_lines"))
    return each.join(kept, "doc", "left").select(F.col("doc").alias("doc_id"), "n_lines", F.coalesce("kept", F.array().cast("array<long>")).alias("kept"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """kept_lines() as counts and the kept lines' numbers, comma-joined."""
    found = kept_lines(docs, key, text, shingle)
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_lines"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """docs with the text cut down to the kept lines, all columns kept. A document with words that keeps none of them goes."""
    own, both, count, stay = fresh(docs, "__key", "__x", "__n", "__kept")
    found = kept_lines(docs, key, text, shingle).groupBy(F.col("doc_id").alias(own)).agg(F.max(F.struct("n_lines", "kept")).alias(both))
    rows = docs.join(found, docs[key].eqNullSafe(found[own]), "left").select(*docs.columns, F.col(f"{both}.n_lines").alias(count), F.col(f"{both}.kept").alias(stay))
    names = list(docs.columns)
    place = names.index(text)

    def run(batches):
        for part in sliced(batches, text):
            data, offsets = flat(part.column(text))
            at, doc, _ = line_offsets(data, offsets) if len(data) else (np.zeros(1, np.int64), np.zeros(0, np.int64), None)
            w = words_of(data, at if len(at) > 1 else np.zeros(1, np.int64)).count if len(data) else np.zeros(0, np.int64)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            raw, texts, stays = data.tobytes(), [], []
            for row, (n, kept, old) in enumerate(zip(part.column(count).to_pylist(), part.column(stay).to_pylist(), part.column(text).to_pylist())):
                if kept is None or n == len(kept):
                    texts.append(old)
                    stays.append(True)
                    continue
                wanted, out = set(kept), []
                for x in range(int(first[row]), int(first[row + 1])):
                    if not w[x] or x - int(first[row]) in wanted:
                        out.append(raw[at[x] : min(at[x + 1], offsets[row + 1])].rstrip(b"\n").decode())
                texts.append("\n".join(out))
                stays.append(bool(kept))
            columns = [part.column(i) for i in range(len(names))]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    return rows.mapInArrow(run, docs.schema)
