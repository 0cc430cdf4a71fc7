"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Language ID drops texts whose language can't be told; line dedup drops lines that many documents
hold; SimHash near-dedup leaves one document of each group; decontamination cuts benchmark
windows out and drops documents of which nothing is left; the last stage encodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, line_dedup, simhash_dedup
from ledgerloom.llm.common import materialize
from ledgerloom.llm.queries import encoded, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters the text has now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are null or have no letter. Learns from the documents themselves; an ambiguous
    language, a null id or a repeated row is no reason to go."""
    return language_id.keep_identified(docs, language_id.train(docs)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that three documents or more hold, but in the largest id that has them. Null texts
    become empty; rows with a null id lose nothing; no document goes."""
    return _documents(line_dedup.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null ids last, one of
    equal rows."""
    return simhash_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of ``benchmark``, and without documents of which no word is left. Null and
    empty texts stay."""
    return _documents(decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests, one row for each document; null texts have no tokens."""
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", remove_benchmark),
    ("encode", encode),
]

#: SQL has no n-gram classifier, XXH64 or BPE; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
