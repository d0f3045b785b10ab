"""A corpus pipeline out of the training-data operators.

Every stage works on all that its predecessor kept and is written as Parquet
and read again, so a lost executor costs at most one stage's tasks.

Defined results: null texts are empty; a null id is an id of its own that sorts
last in exact dedup and is never dropped as a near copy; rows repeated with one
id and text are exact copies, so one stays; a text of any length is one row and
read whole in every stage; an empty table gives an empty result in every stage; extra columns, whatever their names, are carried through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from kairograph.llm.common import Scratch, read_table
from kairograph.llm.queries import MIX_SEED, SOURCE_WEIGHTS, tokenizer_file, tokenizer_pattern


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, SOURCE_WEIGHTS, "source", F.col("n_chars"), MIX_SEED).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_file(), tokenizer_pattern())


STAGES = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "corpus_pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
