"""A training corpus from raw documents: five stages, each one of the ten operators on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``. No stage has SQL; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import mixing, packing, quality, simhash, toxicity
from chronoloom.llm.common import concluded, discard, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labels, does not predict toxic."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio's threshold."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their token ids."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("simhash", near_unique),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the trained network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's documents are written and read again, and the tables of stages before it removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = concluded(spark, partial(stage, spark, before, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
