"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, binary, bpe, decontaminate, linedup, neardup, oracle, pii, secrets_scan, substring, toxicity
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digests(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.QUERY_KEY)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_shards(spark, table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard": op2_jaccard,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_lines": op8_lines,
    "op9_neighbours": op9_neighbours,
    "op10_wavelet": op10_wavelet,
}

#: For the others no SQL can give the rows: they tokenise, learn, search approximately, encrypt, or report places of regex matches.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracle.DECONTAMINATION,
    "op2_jaccard": oracle.JACCARD,
    "op7_substrings": oracle.SUBSTRINGS,
    "op8_lines": oracle.LINES,
}
