"""A training corpus from ``documents``: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared folder, reads them again for the next, and drops what the stage
before the last has read.

In every stage null and empty texts are documents without words: the two
classifiers give them the score of no evidence, the stages on repeats keep
them, and packing gives each its end id. A null id stays. Rows that repeat an
id and its text stay once after near-duplicates; ties go to the least id.
Columns other than doc_id, text, lang, source and n_chars pass through,
whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lastleg.llm import near_dedup, packing, quality, substrings, toxicity
from lastleg.llm.common import Written

#: Words of a repeated passage, from which on the pipeline takes it out.
PASSAGE_WORDS = 50


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over the threshold of the ranking; without labels of both classes all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id; documents without words stay."""
    return near_dedup.keep_one(docs, words=5, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a smaller id has too; a text may become empty."""
    return substrings.without_repeats(docs, width=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("packing", pack),
]

#: Learned classifiers and a tokenizer are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Written(spark)
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        work.drop(keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
