"""Prepare a corpus for training: languages, repeated lines, near copies, benchmark leaks, tokens."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import bpe, decontam, langid, lines, ngrams
from wattframe.llm.common import discard, settled, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell."""
    return langid.reject_unknown(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, equal or one character different, go; so do documents left empty by it."""
    return lines.unique_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, 0.8 of them in common."""
    return ngrams.one_of_each(docs, length=5, near=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number are added."""
    return bpe.tokenize(docs)


STAGES = [
    ("language", language),
    ("repeated lines", repeated_lines),
    ("near copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
