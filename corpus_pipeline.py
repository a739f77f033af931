"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Defined results: every row is judged by its own text, whatever other rows share its id. Null and empty texts, and texts without a letter, have
no language and go in the first stage; a null id is an id like any other, but such a row is nobody's near copy; of rows that repeat a text,
or come near to it, the one with the least id stays, and of rows equal in id and text one; ties are broken by hashes of the text; very long
texts are taken whole in every stage; an empty table gives no rows. The stages return the columns of ``documents``; others are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetika.llm import decontamination, language, line_dedup, ngram_join, packing
from kinetika.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; ``lang`` becomes what was found."""
    model = language.train(docs, holdout=False)
    return language.keep_languages(docs.select(*COLUMNS), model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go; a document that loses all its lines goes as well."""
    out = line_dedup.dedup_lines(docs)
    kept = out.filter((F.col("removed_lines") == 0) | (F.length("text") > 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 1,024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", remove_benchmark),
    ("packing", pack_sequences),
]

#: Suffix automata, MinHash and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
