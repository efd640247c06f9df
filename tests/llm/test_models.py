import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, boosting, toxicity
from quillon.llm.components import components, roots_of
from tests.conftest import DATA


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    p, n = y.sum(), len(y) - y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert (held.predicted == held.toxic).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_edges(spark, docs, empty, by_id):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(by_id))], "doc_id long, toxic int")
    one_class = labels.withColumn("toxic", F.lit(0))
    none = labels.where("doc_id < 0")
    for y in (labels, one_class, none):
        m = toxicity.learn(docs, y)
        rows = toxicity.score(docs, m).collect()
        assert len(rows) == len(by_id) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(empty, m).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, toxicity.learn(docs, one_class))
    assert kept.columns == docs.columns and kept.count() == len(by_id)
    assert toxicity.learn(empty, labels).trees is None


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.boosted(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    iso = boosting.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    v = iso(np.linspace(-1, 5, 20))
    assert (np.diff(v) >= 0).all() and 0 < v[0] < v[-1] < 1


def brute_neighbours(rows):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_exact_on_small(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(45)]  # copies
    bad = [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [None] + [1.0] * 7), (5080, [1.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, list int")
    got = {}
    for r in ann.neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert got.keys() == want.keys()
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1] for m in mine] == [b[0] for b in best]
        assert np.allclose([m[2] for m in mine], [b[1] for b in best], atol=1e-12)


def test_neighbours_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(frame).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.neighbours(frame.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_neighbours_recall(spark, sf):
    frame = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want, got = brute_neighbours(rows), {}
    for r in ann.neighbours(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {b[0] for b in best}) for q, best in want.items()) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("most_lists, sample", [(1024, 20_000), (16, 20_000), (16, 2000)])
def test_neighbours_recall_of_probed_lists(spark, monkeypatch, most_lists, sample):
    """More than CELL vectors, so that not all lists are probed; with one level and two, and beyond the sample."""
    monkeypatch.setattr(ann, "MOST_LISTS", most_lists)
    monkeypatch.setattr(ann, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 32))[rng.integers(80, size=6000)] + 0.7 * rng.normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    fit, fitted = ann.fit, []
    monkeypatch.setattr(ann, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = {}
    for r in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20].astype(float) @ x.T.astype(float)
    score[np.arange(300), np.arange(0, 6000, 20)] = -2
    best = np.argsort(-score, axis=1)[:, :20]
    assert sorted(got) == list(range(0, 6000, 20)) and len(x) > ann.CELL
    recall = sum(len(got[20 * i] & set(b.tolist())) for i, b in enumerate(best)) / best.size
    assert fitted[0].probes < fitted[0].count and recall >= 0.9
    assert (len(fitted[0].second) > 1) == (most_lists == 16)


def test_scan_abandons_candidates_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    q = x[:4] + 0.1 * rng.normal(size=(4, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    for places, score in ann.scan_cell(x, np.zeros(3000, np.int64), q, [np.array([0])] * 4, rotation, 1):
        assert ann.KEEP <= len(places) < 1500


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 400, (300, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(60)] + [[7, 7]]
    got = {r.node: r.component for r in components(spark.createDataFrame([tuple(p) for p in pairs], "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}
    assert roots_of(6, np.array([5, 3, 1]), np.array([4, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]
