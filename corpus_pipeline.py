"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of the documents.

Cases: a null, empty or letterless text has no language and goes in the first stage; a text of which line dedup leaves nothing goes there.
A null id is replaced by a hash of the text wherever rows are told apart. Of copies and near copies the row with the lowest id stays, of equal
ids the one with the lowest hash of the text; rows that are equal in both are one. An empty table gives an empty one. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, line_dedup, near_dedup, packing
from tidemark.llm.common import bucket_of, stored, table
from tidemark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; ``und`` and narrow margins go."""
    return language_id.keep_identified(docs, language_id.dictionaries(docs.where(bucket_of(F.col("doc_id")) != 0)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template an earlier document has."""
    return line_dedup.without_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its place in a training sequence."""
    return packing.sequences(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, alignment and byte-pair merges have no SQL; tests/llm hold run() and every stage against brute force.
ORACLE_SQL = None
