"""Corpus pipeline: language, lines, near copies, benchmark leaks, packing.

Each stage reads what the one before wrote; all but the last return the
columns of ``documents``, further columns of the input among them.

Defined results: a null or empty text tells no language, so it goes at the
first stage; a document of which no line stays goes at the second; of rows
that share the smallest doc_id of a group of near copies all stay; a document
goes at the fourth stage if it leaks any item; rows with a null doc_id are
judged by their text and packed as documents of their own; ties go to the
smallest doc_id (of lines: the earliest place); very long texts are handled
whole at every stage; further columns are carried to the last stage whatever
their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.decontaminate import clean
from attesta.llm.language import keep_identified
from attesta.llm.lines import drop_repeated_lines
from attesta.llm.packing import pack
from attesta.llm.queries import tokenizer_path
from attesta.llm.shingles import keep_one
from attesta.session import remove, scratch_dir, scratch_scope, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language isn't told with enough certainty."""
    return keep_identified(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents of which no line stays."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are similar at 0.8 or more: SimHash links first, MinHash for the rest, all verified."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 4096 ids."""
    pieces, _ = pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the tokenizer, the fingerprints or the model of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has read and written on its way is removed once its result is written.
    """
    docs, root = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            remove(spark, f"{root}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
