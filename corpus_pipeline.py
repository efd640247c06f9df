"""The corpus pipeline: five stages, each an operator of quillon.llm, over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a frame, which run() writes as Parquet into the shared folder and reads
again as the next stage's docs. All stages but the last return the columns of
documents. Documents are named by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, linedup, neardup, toxicity
from quillon.llm.common import discard, table, written
from quillon.llm.queries import tokenizer_path

#: The stages learn from labels and compare texts with each other: not expressible in SQL. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one are cut out; a document that loses all its lines with words goes."""
    return linedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return neardup.keep_first(docs)


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go; from the others the windows are cut out."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of each document, and of the text that they decode to."""
    return bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", repeated_lines),
    ("near copies", near_copies),
    ("decontamination", contaminated_documents),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        given, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", "snappy")
        discard(given)
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage-tokens", "snappy")
