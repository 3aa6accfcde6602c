"""A training corpus from raw documents: five operators of ``tallywatch.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and gives a table with the columns of ``documents``, the
last one the mix. ``run`` writes every stage's result to the shared folder and reads
it back as the next one's input.

Defined results: null, empty and wordless texts have no language and go at the first stage, in
the pipeline at least; ids may be null or repeat, rows are told apart by their texts; repeated
rows are one document after the second stage; a null source is a source; further columns are
carried to the mix; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.llm import decontaminate, language, mixing, ngram_join, substrings
from tallywatch.llm.common import place, positional
from tallywatch.session import stage

#: Documents whose language has less than this share of the evidence are rejected.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: ``und`` and undecided ones go."""
    return language.keep_identified(docs, language.fit(docs), LEAST_SCORE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of copies and near copies."""
    return ngram_join.one_per_class(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; ``n_chars`` follows."""
    done = positional(substrings.dedup_substrings(docs)).drop(f"_{len(docs.columns)}")
    length = F.char_length(f"_{place(docs.columns, 'text')}").cast("bigint")
    return done.withColumn(f"_{place(docs.columns, 'n_chars')}", length).toDF(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, benchmark)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its text: ``mixing.taken_text`` gives the words."""
    return mixing.with_texts(mixing.mix_sources(docs), docs)


STAGES = [
    ("language_id", identified),
    ("ngram_join", distinct_texts),
    ("substring_dedup", without_repeats),
    ("decontaminate", without_leaks),
    ("mix_sources", mixed),
]

#: The language model, MinHash and gear hashes are no SQL; tests hold the result against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
