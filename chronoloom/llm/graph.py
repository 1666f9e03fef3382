"""Connected components by alternating large and small stars, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import HOT_SHARE, discard, materialise


def nearest(rows: DataFrame) -> DataFrame:
    """rows (a, b) with m, the smallest b of their a.

    Every a is dealt into up to HOT_SHARE parts by its b, so a hub's rows lie in many
    tasks; its parts' minima, so many rows at most, meet in one. Rows are dealt once, and
    nothing is broadcast: each broadcast takes a block of the driver's memory, however few
    its rows.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("b"), F.lit(HOT_SHARE))).repartition("a", "__part")
    parts = dealt.groupBy("a", "__part").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(parts.hint("merge"), ["a", "__part"]).select("a", "b", "m")


def pairs(rows: DataFrame, *of: tuple[str, str]) -> DataFrame:
    """Several pairs of columns of each row as rows (a, b), in one pass."""
    each = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in of])
    return rows.select(F.explode(each).alias("__pair")).select("__pair.a", "__pair.b")


def settled(links: DataFrame) -> bool:
    """Whether links (a, b), none twice, are stars: a node that has a link to a smaller one has no other link."""
    ends = links.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "a").cast("int").alias("up")) for c in "ab"])).alias("__end"))
    ends = ends.groupBy("__end.node").agg(F.max("__end.up").alias("up"), F.count("*").alias("n"))
    return ends.agg(F.count_if((F.col("up") == 1) & (F.col("n") > 1))).first()[0] == 0


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a of edges (a, b) but the smallest of its component, which is b.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node it knows. Only a count of a round reaches the driver, and its edges are
    written, so that lineage stays short. Self-loops, repeats and null nodes are dropped.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    links = materialise(links, "links")
    while not settled(links):
        large = nearest(pairs(links, ("a", "b"), ("b", "a"))).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = pairs(nearest(large), ("a", "m"), ("b", "m")).filter(F.col("a") > F.col("b")).distinct()
        following = materialise(small, "links")
        discard(links)
        links = following
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node. No edges give no rows."""
    links = stars(edges)
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
