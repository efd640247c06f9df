"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon of insults and of a lexicon learned from
labels (whole words, and word beginnings of 4 to 6 bytes), nearness of both to
second-person words, capitals, punctuation, and signs of obfuscation (digits or
signs put for letters, runs of signs, single letters). The text alone is used.

Learning: at most SAMPLE labelled rows, those with the least hash of their id,
never held-out ones. One half gives the learned lexicon, of the other three
quarters the trees and one quarter the calibration, so that no row is scored by
terms learned from itself. The counts, features and scores come from executors;
the driver holds the sample's features (about 100 bytes a row) and the model.

Held out: crc32 of the id's decimal text modulo 5 is 0. Null texts are empty and
get a score like any other. With no labelled rows of both kinds, all scores are
the share of toxic labels (0 without any). Repeated rows are scored row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, boosted, isotonic
from .common import discard, file_count, prepare, written
from .textops import LOWER, U64, flat, sliced, span_hashes, words_of

SAMPLE = 20_000
LEXICON = 4096  # learned terms, at most
LEAST_ROWS = 3  # toxic rows of the lexicon's half that hold a learned term, at least
PREFIXES = (4, 5, 6)
NEAR = 5  # words

# Common insults, and second-person words of some languages.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile fool fools jerk creep filth vermin pig pigs bastard bitch ugly hate shut retard crap damn hell freak coward parasite rat rats kill die".split()
SECOND_PERSON = "you your yours yourself u ur youre tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus".split()

_leet = np.arange(256)
for _sign, _letter in zip(b"013457@$!|", b"oieastasii"):
    _leet[_sign] = _letter
LEET = LOWER[_leet]
_codes = np.arange(256)
UPPERCASE = (_codes >= 65) & (_codes <= 90)
LETTER = UPPERCASE | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
DIGIT = (_codes >= 48) & (_codes <= 57)
MARKS = np.isin(_codes, list(b"!?"))
SIGNS = np.isin(_codes, list(b"#$%&*@^~+=<>|\\/_"))

FEATURES = [
    "insults", "insult_share", "learned", "learned_share", "learned_weight", "learned_most", "near_second_person", "second_person", "capitals", "capital_words",
    "marks", "signs", "sign_runs", "digits_in_words", "disguised", "single_letters", "log_words", "word_length",
]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def hashes_of(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    return np.unique(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


def found_in(values: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are among the sorted terms, their places)."""
    if not len(terms) or not len(values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
    return terms[at] == values, at


def term_hashes(data: np.ndarray, w) -> list[np.ndarray]:
    """For each word: its hash, then the hashes of its beginnings (0 where the word is no longer than that)."""
    lower, out = LOWER[data], [w.hash]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        h = np.zeros(len(w.hash), U64)
        if len(long):
            # the kind is mixed in: a beginning is another term than the word of those letters
            h[long] = span_hashes(lower, w.start[long], w.start[long] + n) ^ U64(n)
        out.append(h)
    return out


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes of the learned lexicon
    weights: np.ndarray
    trees: Trees | None = None
    calibration: Isotonic | None = None
    prior: float = 0.0

    def features(self, column) -> np.ndarray:
        data, offsets = flat(column)
        rows = len(offsets) - 1
        out = np.zeros((rows, len(FEATURES)))
        if not len(data):
            return out
        w = words_of(data, offsets)
        size = np.maximum(np.diff(offsets), 1)
        n = np.maximum(w.count, 1)

        def per_row(hit: np.ndarray, weight=None) -> np.ndarray:
            return np.bincount(w.row[hit], weight, rows) if hit.any() else np.zeros(rows)

        def per_byte(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

        insult, _ = found_in(w.hash, _INSULTS)
        you, _ = found_in(w.hash, _SECOND_PERSON)
        learned, weight = np.zeros(len(w.hash), bool), np.zeros(len(w.hash))
        for h in term_hashes(data, w):
            hit, at = found_in(h, self.terms)
            learned |= hit
            if len(self.terms):
                weight = np.maximum(weight, np.where(hit, self.weights[at], 0))
        most = np.zeros(rows)
        np.maximum.at(most, w.row, weight)
        bad = np.flatnonzero(insult | learned)
        near = np.zeros(rows)
        at_you = np.flatnonzero(you)
        if len(bad) and len(at_you):
            place = np.searchsorted(at_you, bad)
            for other in (at_you[np.minimum(place, len(at_you) - 1)], at_you[np.maximum(place - 1, 0)]):
                close = (np.abs(other - bad) <= NEAR) & (w.row[other] == w.row[bad])
                near += np.bincount(w.row[bad[close]], minlength=rows)
        capital = UPPERCASE[data]
        caps = np.concatenate([[0], np.cumsum(capital)])
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        length = w.end - w.start
        has_digit, has_letter = digits[w.end] > digits[w.start], letters[w.end] > letters[w.start]
        plain = words_of(LEET[data], offsets)
        disguised, _ = found_in(plain.hash, _INSULTS)
        sign = SIGNS[data]
        run = sign.copy()
        run[1:] &= sign[:-1]
        run[0] = False
        values = [
            per_row(insult), per_row(insult) / n, per_row(learned), per_row(learned) / n, per_row(learned, weight[learned]) / n, most, near, per_row(you) / n,
            per_byte(capital) / size, per_row((caps[w.end] - caps[w.start] == length) & (length > 2)) / n, per_byte(MARKS[data]) / size, per_byte(sign) / size, per_byte(run) / size,
            per_row(has_digit & has_letter) / n, np.maximum(0, np.bincount(plain.row[disguised], minlength=rows) - per_row(insult)), per_row(length == 1) / n, np.log1p(w.count), np.bincount(w.row, length, rows) / n,
        ]
        for j, v in enumerate(values):
            out[:, j] = v
        return out

    def scores(self, column) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.prior)
        return np.clip(self.calibration(self.trees.margin(self.features(column))), 0.0, 1.0)


_INSULTS, _SECOND_PERSON = hashes_of(INSULTS), hashes_of(SECOND_PERSON)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """doc_id, text, toxic, part (0: lexicon, 1: trees, 2: calibration) of the sample."""
    hashed = F.xxhash64(F.col("k").cast("string"), F.lit("toxicity"))
    chosen = (
        labels.select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("k").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("k")))
        .groupBy("k")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(hashed, "k")
        .limit(most)
        .withColumn("part", F.when(F.pmod(hashed, F.lit(2)) == 0, 0).when(F.pmod(F.shiftright(hashed, 1), F.lit(4)) == 0, 2).otherwise(1))
    )
    # the sample's size is bounded by a parameter, so it may be broadcast
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "k").select("k", "text", "toxic", "part")


def lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms that lean to toxic rows, and their log odds."""
    def toxic_terms(batches):
        for part in sliced(batches):
            data, offsets = flat(part.column("text"))
            w = words_of(data, offsets)
            found = [distinct_terms(h, w.row) for h in term_hashes(data, w)]
            terms, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"])

    own = sample.where("part = 0")
    counted = own.where("toxic = 1").select("text").mapInArrow(toxic_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
    got = counted.toPandas()  # bounded by the sample
    if not len(got):
        return np.zeros(0, U64), np.zeros(0)
    terms = got["term"].to_numpy().view(U64)
    order = np.argsort(terms)
    terms, toxic = terms[order], got["n"].to_numpy()[order]

    def clean_counts(batches):
        for part in sliced(batches):
            data, offsets = flat(part.column("text"))
            w = words_of(data, offsets)
            for h in term_hashes(data, w):
                hit, at = found_in(h, terms)
                pairs = np.unique(w.row[hit] * len(terms) + at[hit])
                places, counts = np.unique(pairs % len(terms), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["place", "n"])

    rest = own.where("toxic = 0").select("text").mapInArrow(clean_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    clean = np.zeros(len(terms))
    clean[rest["place"].to_numpy()] = rest["n"].to_numpy()
    n = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    odds = np.log((toxic + 0.5) / (n.get(1, 0) + 1)) - np.log((clean + 0.5) / (n.get(0, 0) + 1))
    keep = np.flatnonzero(odds > 1.5)
    keep = np.sort(keep[np.argsort(-odds[keep] * np.log1p(toxic[keep]), kind="stable")[:LEXICON]])
    return terms[keep], odds[keep]


def distinct_terms(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """h of each distinct pair (row, h), without the 0 that stands for no term."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep & (h != 0)]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    prepare(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, key, text, most), "toxicity-sample", files=file_count(docs))
    terms, weights = lexicon(sample)
    model = Model(terms, weights)

    def features(batches):
        for part in sliced(batches):
            x = model.features(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column("toxic"), part.column("part"), part.column("k").cast(pa.string())], names=["x", "toxic", "part", "k"])

    got = sample.where("part > 0").mapInArrow(features, "x array<double>, toxic int, part int, k string").toPandas().sort_values("k", kind="stable")
    discard(sample)
    if not len(got):
        return model
    x, y, part = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float), got["part"].to_numpy()
    model.prior = float(y.mean())
    if 0 < y[part == 1].sum() < (part == 1).sum() and 0 < y[part == 2].sum() < (part == 2).sum():
        model.trees = boosted(x[part == 1], y[part == 1])
        model.calibration = isotonic(model.trees.margin(x[part == 2]), y[part == 2])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (false without an id), score, predicted."""
    prepare(docs.sparkSession)

    def run(batches):
        for part in sliced(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(model.scores(part.column(text)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(key, text).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs whose score is below 0.5, all columns kept."""
    prepare(docs.sparkSession)

    def run(batches):
        for part in sliced(batches, text):
            yield part.filter(pa.array(model.scores(part.column(text)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
