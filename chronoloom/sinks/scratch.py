"""Intermediate tables in the folder that driver and executors share: they cut long plans and keep models from running twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from chronoloom.sinks.files import Folder


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder for a session on one machine, and ValueError on a cluster.

    A session has one temporary folder, which is removed when it ends.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(context, "_chronoloom_folder"):
        context._chronoloom_folder = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        folder = Folder(spark, context._chronoloom_folder)
        folder.files.deleteOnExit(folder._at(""))
    return context._chronoloom_folder


def written(df: DataFrame, name: str, told: dict | None = None, **counts: Column) -> DataFrame:
    """df written once and read back; its files go when the application ends. counts, aggregates over df, are taken as it is written and put into told."""
    spark = df.sparkSession
    folder = Folder(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    seen = Observation() if counts else None
    (df.observe(seen, *[c.alias(k) for k, c in counts.items()]) if seen else df).write.parquet(folder.path)
    if seen:
        told.update(seen.get)
    folder.files.deleteOnExit(folder._at(""))
    return spark.read.schema(df.schema).parquet(folder.path)
