"""The training-data pipeline: five stages over the documents, each written and read again.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Labels come from ``sf_dir``. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import mixing, packing, quality_rules, simhash, toxicity
from mnemospark.llm.common import read, scratch, write


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier, Newton iterations and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            made = keep(write(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last is not None:
            last.drop()
        docs, last = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
