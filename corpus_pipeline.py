"""Documents to packed training sequences; each stage's result is written and read again.

Stages, in order: language ID (documents whose language cannot be told go), exact dedup, n-gram Jaccard join (the first
document of each class stays), mixing sources to target weights (documents are repeated or left out), best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import exact_dedup, language_id, mixing, ngram_join, packing
from passagework.llm.queries import table, tokenizer_files
from passagework.llm.scratch import written

#: A document goes if the mean of its words' best posteriors is below this; a text in several languages is sure word by word.
LEAST_CERTAINTY = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.with_language(docs).where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY)).drop("lang_pred", "score", "certainty")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *tokenizer_files(), keep_ids=False).drop("ids")


STAGES = [
    ("language", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", one_of_each_class),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned and seeded stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
