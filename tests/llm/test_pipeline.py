"""The corpus pipeline against brute force, stage by stage, and its edge cases."""

import os
import random
import re
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import toxicity
from tests.conftest import ROOT
from tests.llm.test_text_operators import brute_classes, brute_hits, brute_lines, reference, sha, words  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, __spans int"
WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+[^A-Za-z0-9\x80-\U0010ffff]*")


@pytest.fixture(scope="module")
def tables(spark, by_id, tmp_path_factory):
    """A folder with documents of all kinds (columns with clashing names, a null id), labels and benchmark items."""
    r = random.Random(4)
    texts = dict(by_id)
    rude = ["idiot", "stupid", "moron", "scum", "trash"]
    mild = [f"plain{i}" for i in range(300)]
    toxic = {}
    for i in range(1000, 1400):
        said = [r.choice(mild) for _ in range(r.randint(30, 60))]
        toxic[i] = int(i % 2 == 0)
        if toxic[i]:
            for _ in range(8):
                said.insert(r.randrange(len(said)), "you " + r.choice(rude).upper() + "!!")
        texts[i] = " ".join(said)
    items = [(1, " ".join(words(by_id[0] or by_id[37])[:20]) or "none"), (2, " ".join(f"item{i}" for i in range(30))), (3, " ".join(words(texts[1001])[3:25])), (4, None)]
    far = " ".join(f"far{i}" for i in range(900))
    texts[2000] = f"{far}, {items[1][1]} {far} tail."
    texts[2001] = f"{items[1][1]}\n{items[1][1]} end"
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", 1, "z", 5) for i, t in texts.items()]
    spark.createDataFrame([*rows, (None, "a text without an id, item1 item2", "en", "s", 1, "z", 5)], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def staged(spark, folder, docs=None):
    """What each stage gives, and what it was given."""
    out, now = {}, spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    for name, stage in corpus_pipeline.STAGES:
        given, now = now, stage(spark, now, folder)
        now = spark.createDataFrame(now.collect(), now.schema)
        out[name] = (given, now)
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force(spark, tables, reference):  # noqa: F811
    folder, items = tables
    stages = staged(spark, folder)
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "decontamination", "tokens"]
    assert all(stages[n][1].columns == columns for n in list(stages)[:-1])

    given, left = stages["toxicity"]
    model = toxicity.learn(given, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(given, model).collect() if r.predicted}
    assert texts_of(left) == {d: t for d, t in texts_of(given).items() if d not in bad}
    assert len(bad) > 150 and sum(d % 2 == 0 for d in bad if d and d >= 1000) > 0.9 * len(bad)

    given, left = map(texts_of, stages["line dedup"])
    want = {None: given.pop(None)}
    for d, (n, gone, kept) in brute_lines(given).items():
        lines = given[d].split("\n") if given[d] else []
        lines = lines[:-1] if lines and not lines[-1] else lines
        stay = set(map(int, kept.split(","))) if kept else set()
        if not gone:
            want[d] = given[d]
        elif stay:
            want[d] = "\n".join(x for k, x in enumerate(lines) if k in stay or not words(x))
    assert left == want and len(left) < len(given)

    given, left = map(texts_of, stages["near copies"])
    classes = brute_classes({d: t for d, t in given.items() if d is not None})
    assert left == {d: t for d, t in given.items() if d is None or classes[d][0] == d}

    given, left = map(texts_of, stages["decontamination"])
    found, want = brute_hits(given, items), {}
    windows = {tuple(w[j : j + min(13, len(w))]) for w in (words(t) for _, t in items) if w for j in range(len(w) - min(13, len(w)) + 1)}
    for d, t in given.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not found[d][4]:
            parts = WORD.findall(t or "")
            want[d] = t if not hit else t[: WORD.search(t).start()] + "".join(p for k, p in enumerate(parts) if k not in hit)
    assert left == want and 2001 in given and 2001 not in left and left[2000] != given[2000]
    assert all(not v[1] for v in brute_hits(left, items).values())

    given, tokens = stages["tokens"]
    tokenizer, got = reference[0], {r.doc_id: r for r in tokens.collect()}
    assert got.keys() == texts_of(given).keys()
    for d, t in texts_of(given).items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[d].decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_run_is_the_stages_one_after_the_other(spark, tables):
    folder, _ = tables
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, staged(spark, folder)["tokens"][1].collect()), key=str)


def test_repeated_rows_and_empty_tables(spark, tables, monkeypatch):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *_: model)
    once = Counter(tuple(r) for r in staged(spark, folder, docs)["tokens"][1].collect())
    twice = Counter(tuple(r) for r in staged(spark, folder, docs.union(docs))["tokens"][1].collect())
    assert twice == once + once
    for df in (docs.where("doc_id < 0"), docs.selectExpr("doc_id", "cast(null as string) as text", *docs.columns[2:])):
        assert staged(spark, folder, df)["tokens"][1].count() == df.count()


def test_operators_ship_the_package(tmp_path):
    """Without PYTHONPATH and without common.table(), workers find the package."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "one line\\none line"), (2, None)], "doc_id long, text string")
from quillon.llm import linedup
print("rows", linedup.dedup(docs).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in out.stdout, out.stderr[-2000:]
