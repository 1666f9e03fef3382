"""Attributed speakers against a labelled record of who spoke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import SPACE
from chronoloom.operators.temporal import as_of

#: How much earlier than its label a segment may begin.
EARLY_US = 2_000_000
READING = "（"


def bare_name(name: Column) -> Column:
    """A name without white space and without its reading in parentheses."""
    return F.split_part(F.regexp_replace(name, f"{SPACE}+", ""), F.lit(READING), F.lit(1))


def same_person(attributed: Column, labelled: Column) -> Column:
    """Whether one name holds the other, or both begin alike in two characters; recognisers misread the rest."""
    a, b = F.regexp_replace(attributed, f"{SPACE}+", ""), bare_name(labelled)
    return a.contains(b) | b.contains(a) | (F.substring(a, 1, 2) == F.substring(b, 1, 2))


def labelled(segments: DataFrame, labels: DataFrame, early_us: int = EARLY_US) -> DataFrame:
    """segments (video, ord, start_us) with label: the name of the label in force, null before the first one.

    A label (video, t_us, ord, name) holds from early_us before its time to the next one's;
    where two hold, the later wins, so this is one as-of join.
    """
    out = as_of(segments.withColumn("__at", F.col("start_us") + early_us), labels, ["name"], at="__at")
    return out.withColumn("label", F.col("__back.name")).drop("__back", "__ahead", "__at")


def precision(segments: DataFrame, *by: str) -> DataFrame:
    """Counts over segments with speaker and label: all, attributed, aligned with a label, matched, and the share of these."""
    named, aligned = F.col("speaker").isNotNull(), F.col("speaker").isNotNull() & F.col("label").isNotNull()
    out = segments.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(named).alias("n_named"), F.count_if(aligned).alias("n_aligned"),
        F.count_if(aligned & same_person(F.col("speaker"), F.col("label"))).alias("n_matched"),
    )
    return out.withColumn("precision", F.when(F.col("n_aligned") > 0, F.col("n_matched") / F.col("n_aligned")).otherwise(F.lit(0.0)))
