"""Runs of equal rows on a timeline: collapse, end times, dwell times.

A timeline is a DataFrame with ``video`` (its key), ``t_us`` (microseconds from its start)
and ``ord`` (unique in the video, breaks ties). Videos are worked on in stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import UNKNOWN_APP, truthy
from chronoloom.operators.stretches import beside

RUN_KEY = ("action", "resource", "location")


def collapse_runs(entries: DataFrame, key: Sequence[str] = RUN_KEY) -> DataFrame:
    """The first row of each run of equal keys; null equals null."""
    same = F.col("__before").isNotNull()
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__before.{c}"))
    return beside(entries, before=key).filter(~same).drop("__before")


def with_ends(entries: DataFrame, timeline_ends: DataFrame) -> DataFrame:
    """Add end_us and duration_us: the next entry's start; for the last one timeline_end_us, but not before its own start.

    timeline_ends has one row (video, timeline_end_us) per video that was observed at all;
    without one the last end stays null. That row meets one row a stretch.
    """
    out = beside(entries, after=["t_us"], past=timeline_ends.select("video", F.col("timeline_end_us").alias("__end")))
    last = F.when(F.col("__end").isNotNull(), F.greatest("t_us", "__end"))
    out = out.withColumn("end_us", F.when(F.col("__after").isNull(), last).otherwise(F.col("__after.t_us"))).drop("__after", "__end")
    return out.withColumn("duration_us", F.col("end_us") - F.col("t_us"))


def timeline_ends(observations: DataFrame) -> DataFrame:
    return observations.groupBy("video").agg(F.max("t_us").alias("timeline_end_us"))


def dwell_by_app(entries: DataFrame, *more: str) -> DataFrame:
    """Total known, positive duration per application, unknown ones together; first is the first-seen order of ties."""
    app = F.coalesce(truthy(F.col("app")), F.lit(UNKNOWN_APP)).alias("app")
    totals = entries.filter(F.col("duration_us") > 0).groupBy(*more, app)
    return totals.agg(F.sum("duration_us").alias("total_us"), F.count("*").alias("n_entries"), F.min("ord").alias("first_ord"))
