"""Mixing sources to target weights.

Tokens are summed per source, every source gets a target, and its repetition rate is
target over size. A document is emitted floor(rate) times, plus one more copy with
probability equal to the fraction. That draw compares the fraction with a number
hashed from the seed and the document's id, once: it needs no state and no order, one
document's copies never depend on another's, and reruns agree. So a source's words miss
its target by chance, with the standard deviation

    sqrt(f * (1 - f) * sum of squared sizes),    f the fraction of its rate,

which is small against the target unless a few documents hold most of a source.

Plan: words are counted once. Copies follow from a source's rate and the document's id
alone, so emitting them reads no text but to hand it on; rates come to the rows by
broadcast, and by a join without hot keys where sources are many.

Edge cases: null or empty texts have size 0 and take nothing, yet are returned; null
sources are one source, last in order; repeated rows are drawn alike; an empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_ROWS, WORD, materialise, running, shielded, spread_join, table

WEIGHTS = (5, 2, 1)
#: The mix takes three halves of all words, and no source more than twice its own.
SHARE_HALVES = 3
MOST = 2
SEED = "mix-1"


def words_in(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_halves: int = SHARE_HALVES, most: int = MOST) -> DataFrame:
    """Each source's target; sizes has source and source_size, one row per source.

    Sources take their weights in code-point order, null last. Sources above ``most``
    times their size are held there and the excess is shared again by weight among the
    others, until none is above. Every round is one aggregate; only its two sums reach
    the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = running(sizes, order, {"nth": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    cap, total = F.lit(most) * F.col("source_size"), ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # halves, so that all sums stay whole numbers
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        held, free = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        now = (share_halves * total - 2 * (held or 0)) / (2 * free)
        if now == level:
            break
        level = now
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def drawn(rate: Column, u: Column) -> Column:
    """floor(rate) copies and one more if u is below the fraction."""
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame) -> tuple[DataFrame, int]:
    """__source, __source_size, __target, __rate and __n (documents) of every source, and the number of sources. docs has source and __size."""
    sizes = docs.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("__n"))
    sizes = materialise(sizes, "source-sizes")
    goal = targets(sizes.select("source", "source_size")).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.join(sizes.select(F.col("source").alias("__same"), "__n"), F.col("__source").eqNullSafe(F.col("__same")))
    goal = goal.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate"), "__n")
    return materialise(goal, "goals"), sizes.count()


def with_copies(docs: DataFrame, goals: tuple[DataFrame, int], seed: str = SEED) -> DataFrame:
    """Add __source_size, __target and __copies to every document; other columns stay. docs must come from a scan, whose row order is fixed."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = docs.withColumn("__u", draw(seed, key))
    goal, known = goals
    if known <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("__source")))
    else:
        named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
        out = spread_join(rows.withColumn("__key", named), goal.withColumn("source", F.col("__source")).withColumn("__key", named).drop("source"), "__key", F.monotonically_increasing_id()).drop("__key")
    return out.withColumn("__copies", drawn(F.col("__rate"), F.col("__u"))).drop("__source", "__u", "__rate", "__n")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: every row as often as the mix takes it, with its columns.

    Documents without words weigh nothing and are repeated like the others of their source.
    """
    inner = shielded(docs, "doc_id", "text", "source")
    taken = with_copies(inner, rates(inner.select("source", words_in().alias("__size"))), seed).filter(F.col("__copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*inner.columns).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", words_in().alias("__size"))
    # the id stands for the text, which only a row without id is drawn by
    short = materialise(docs.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text"))), "sizes")
    out = with_copies(short, rates(short))
    return out.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total,
         coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         row_number() OVER w AS nth
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source)
), l AS (
  SELECT arg_min((3 * total - 2 * held)::DOUBLE / (2 * free)::DOUBLE, nth) AS level FROM o
  WHERE (3 * total - 2 * held)::DOUBLE / (2 * free)::DOUBLE * weight <= 2 * source_size
), t AS (
  SELECT s.source, s.source_size, CASE WHEN level IS NULL THEN 2.0 * source_size ELSE least(2.0::DOUBLE * source_size, weight * level) END::DOUBLE AS target
  FROM s, l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END::DOUBLE AS rate,
         ('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
