"""Neighbours and numbers along a timeline without a whole video in one task.

A video is cut into stretches of time. Windows run inside a stretch; what crosses a
border (the row before, the row after, how many rows came earlier) is carried from one
aggregated row per stretch. So the unit of work is a stretch, however long a video is,
and only the borders of one video, one short row a stretch, are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH_US = 3_600_000_000
#: Rows that are numbered by an id fall into stretches of so many ids.
STRETCH_IDS = 10_000

ORDER = ("t_us", "ord")
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def stretch(c: str | Column, width: int = STRETCH_US) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / width).cast("long")


def place_of(key: str, at: str | Column, width: int = STRETCH_US) -> Column:
    """A row's stretch, with its key: as a struct it is never null itself, so that rows of a null key or time meet their own."""
    return F.struct(F.col(key).alias("key"), stretch(at, width).alias("stretch"))


def beside(rows: DataFrame, before: Sequence[str] = (), after: Sequence[str] = (), key: str = "video", order: Sequence[str] = ORDER, width: int = STRETCH_US, past: DataFrame | None = None) -> DataFrame:
    """rows with __before and __after: structs of those columns of the row before and the row after, null at the ends.

    order's first column is cut into stretches of width; all of order together is unique in
    a video. Rows of a null key are one timeline; a null time comes first. past has a row
    (key and others) for some keys, whose other columns all rows of the key get; it meets the
    borders only.
    """
    cut = rows.withColumn("__at", place_of(key, order[0], width))
    inside, along, place = Window.partitionBy("__at").orderBy(*order), Window.partitionBy("__at.key").orderBy("__at.stretch"), F.struct(*order)
    sides = [("__before", before, F.max_by, F.lag), ("__after", after, F.min_by, F.lead)]
    borders = cut.groupBy("__at").agg(*[pick(F.struct(*cols), place).alias(name) for name, cols, pick, _ in sides if cols])
    for name, cols, _, step in sides:
        if cols:
            cut = cut.withColumn(f"{name}_in", step(F.struct(*cols)).over(inside))
            borders = borders.withColumn(f"{name}_border", step(name).over(along)).drop(name)
    if past is not None:
        borders = borders.join(past.withColumnRenamed(key, "__past"), F.col("__at.key").eqNullSafe(F.col("__past")), "left").drop("__past")
    out = cut.join(borders, "__at")
    for name, cols, _, _ in sides:
        if cols:
            out = out.withColumn(name, F.coalesce(f"{name}_in", f"{name}_border")).drop(f"{name}_in", f"{name}_border")
    return out.drop("__at")


def counted(rows: DataFrame, name: str, value: Column, key: str = "video", order: Sequence[str] = ORDER, width: int = STRETCH_US) -> DataFrame:
    """rows with name: the total of value over their video's rows up to and including their own."""
    cut = rows.withColumns({"__at": place_of(key, order[0], width), "__value": value})
    sums = cut.groupBy("__at").agg(F.sum("__value").alias("__held"))
    earlier = F.sum("__held").over(Window.partitionBy("__at.key").orderBy("__at.stretch").rowsBetween(FIRST, -1))
    sums = sums.select("__at", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    own = F.sum("__value").over(Window.partitionBy("__at").orderBy(*order).rowsBetween(FIRST, 0))
    out = cut.withColumn("__own", own).join(sums, "__at")
    return out.withColumn(name, (F.col("__earlier") + F.col("__own")).cast("long")).drop("__at", "__value", "__own", "__earlier")


def numbered(rows: DataFrame, name: str, key: str = "video", order: Sequence[str] = ORDER, width: int = STRETCH_US) -> DataFrame:
    """rows with name: their place in the video, from 0. Rows whose key is null count together; those of a null time come first."""
    return counted(rows, name, F.lit(1), key, order, width).withColumn(name, F.col(name) - 1)
