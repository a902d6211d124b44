"""The registered queries of the operators for training text, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import (
    bpe,
    codes,
    decontam,
    exact,
    langid,
    lines,
    negatives,
    ngrams,
    packing,
    passages,
    substrings,
    toxicity,
    warc,
)
from wattframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op9_language(spark, folder):
    return langid.identify_languages(table(spark, folder, "documents"))


@query
def op3_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"))


@query
def op4_warc(spark, folder):
    return warc.archive(table(spark, folder, "pages"))


@query
def op6_exact(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


ORACLE["op4_warc"] = warc.SQL
ORACLE["op6_exact"] = exact.SQL


@query
def op7_lines(spark, folder):
    return lines.dedup_lines(table(spark, folder, "documents"))


@query
def op8_ngram_jaccard(spark, folder):
    return ngrams.jaccard_components(table(spark, folder, "documents"))


@query
def op5_passages(spark, folder):
    return passages.substring_dedup(table(spark, folder, "documents"))


ORACLE["op5_passages"] = passages.SQL


@query
def op1_decontaminate(spark, folder):
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_substrings(spark, folder):
    return substrings.substring_removal(table(spark, folder, "documents"))


@query
def op11_negatives(spark, folder):
    return negatives.mine(table(spark, folder, "embeddings"))


ORACLE["op11_negatives"] = negatives.SQL


@query
def op12_codes(spark, folder):
    return codes.compress(table(spark, folder, "embeddings"))


ORACLE["op12_codes"] = codes.SQL


@query
def op13_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))
