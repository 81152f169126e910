"""Corpus preparation: language, exact and near duplicates, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents, and any others that the table has, whatever their names.

Defined results: a null, empty or letterless text is in no language and goes in the first stage.
Rows are judged one by one, so rows that share an id or have none are documents of their own;
repeated rows (equal in id and text) are exact copies, of which one stays. Ties between copies go to
the largest id in exact dedup and to the least in near dedup, where a null id is the least. Very long
texts are worked on whole. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import decontamination, exact_dedup, language_id, ngram_join, packing
from wayfarer.llm.common import collected, remove, settled, table

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; those without letters or in none of the learned languages go."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shared five-word shingles, the document with the least id stays."""
    return ngram_join.keep_one_of_each(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows of test items cover; those that are little else go."""
    return decontamination.remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", sequences),
]
#: The first and third stages have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, read)  # what the stage has read, once its own result is stored
        read = made
    return STAGES[-1][1](spark, docs, sf_dir)
