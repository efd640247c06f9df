"""Repeated rows, null ids and null texts for the operators on documents."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, binary, bpe, linedup, neardup, pii, secrets_scan, substring
from quillon.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

OPERATORS = {
    "op2": neardup.classes,
    "op3": secrets_scan.digests,
    "op4": lambda d: bpe.round_trip_digests(d, tokenizer_path()),
    "op6": lambda d: pii.pseudonymise(d, b"key"),
    "op7": substring.report,
    "op8": linedup.report,
}


@pytest.fixture(scope="module")
def few(docs):
    return docs.where("doc_id % 3 = 0").cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(few, name):
    run = OPERATORS[name]
    once = sorted((tuple(r) for r in run(few).collect()), key=str)
    twice = sorted((tuple(r) for r in run(few.union(few)).collect()), key=str)
    if name == "op2":  # a row more of each text is a copy more
        assert [t[:2] for t in twice] == [o[:2] for o in once for _ in range(2)]
    else:
        assert twice == [o for o in once for _ in range(2)]


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(few, name):
    run = OPERATORS[name]
    nameless = few.withColumn("doc_id", F.when(F.col("doc_id") > 30, F.col("doc_id")))
    rows = run(nameless).collect()
    named = [r for r in rows if r.doc_id is not None]
    assert len(named) == few.where("doc_id > 30").count()
    assert len(rows) - len(named) == (0 if name == "op8" else few.where("doc_id <= 30").count())
    if name == "op2":
        assert all(r.class_id is None and r.n_links == 0 for r in rows if r.doc_id is None)
    if name == "op7":
        assert all(r.n_removed == 0 for r in rows if r.doc_id is None)


def test_token_shards_of_repeated_rows(spark, few):
    rows = binary.token_shards(spark, few.union(few), tokenizer_path()).orderBy("start").collect()
    assert len(rows) == 2 * few.count()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_neighbours_of_repeated_rows(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a, b = ann.neighbours(frame), ann.neighbours(frame.union(frame))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_only_null_texts(spark):
    frame = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    for name, run in OPERATORS.items():
        assert run(frame).count() == 5, name


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_texts_longer_than_a_slice(spark):
    """Texts beyond SLICE_BYTES, with a repeated passage and a near copy, against brute force."""
    import random

    from quillon.llm.textops import SLICE_BYTES
    from tests.llm.test_text_operators import brute_classes, brute_lines, brute_repeats

    r = random.Random(6)
    vocabulary = [f"{chr(97 + i % 26)}word{i}" for i in range(5000)]
    long = [" ".join(r.choice(vocabulary) for _ in range(120_000)) for _ in range(2)]
    long.append(long[0][:-3000] + " another end")
    long[1] = long[1][:500_000] + "\n" + long[0][200_000:201_000] + "\n" + long[1][500_000:]
    by_id = dict(enumerate([*long, "short", None, long[0][200_100:200_400]]))
    assert min(len(t) for t in long) > SLICE_BYTES
    frame = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert {x.doc_id: (x.class_id, x.n_links) for x in neardup.classes(frame).collect()} == brute_classes(by_id)
    assert {x[0]: tuple(x[1:]) for x in substring.report(frame).collect()} == brute_repeats(by_id)
    assert {x[0]: tuple(x[1:]) for x in linedup.report(frame).collect()} == brute_lines(by_id)
