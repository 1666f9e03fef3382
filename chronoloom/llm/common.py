"""What the operators of this subpackage share: scratch tables, running totals, worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, wherever a contract speaks of words; as a Java and as a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many rows may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 10_000
#: The same for tables that are a single number a row.
BROADCAST_IDS = 500_000
#: A key with more than one in so many rows is joined by broadcast: there are fewer such keys than this.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, in the one that driver and executors share.

    That is ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder
    serves a session on one machine (master ``local``); a cluster's session raises, as
    each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not hasattr(context, "_chronoloom_scratch"):
            context._chronoloom_scratch = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        configured = context._chronoloom_scratch
    return f"{configured.rstrip('/')}/chronoloom-{context.applicationId}"


def _tables(spark: SparkSession) -> list[str]:
    """The intermediate tables that the application has written and not removed."""
    return spark.sparkContext.__dict__.setdefault("_chronoloom_tables", [])


def _file(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed like an intermediate table."""
    files, where = _file(spark, shared_dir(spark))
    if not _tables(spark):
        files.mkdirs(where)
        files.deleteOnExit(where)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables(spark).append(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors.

    As results are lazy, the table stays until discard(), release() or the end of the
    application, which removes its folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialise() wrote and nothing will read again."""
    path = getattr(df, "_chronoloom_path", None)
    if path in _tables(df.sparkSession):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _file(spark, path)
    files.delete(where, True)
    _tables(spark).remove(path)


def release(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Remove the intermediate tables of all results so far; for callers that have written or collected these."""
    for path in [p for p in _tables(spark) if p not in keep]:
        _remove(spark, path)


def concluded(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a table, without the intermediate tables that were written on the way to it."""
    before = list(_tables(spark))
    out = materialise(make(), name)
    release(spark, [*before, out._chronoloom_path])
    return out


def spread_join(rows: DataFrame, named: DataFrame, key: str, salt: Column, total: int | None = None) -> DataFrame:
    """rows joined with named (one row a key, and how many of rows have it as __n), without a hot key in one task.

    A key with more than one in HOT_SHARE of the rows is split into as many parts as bring
    it down to that share; such keys and their parts are fewer than 2 * HOT_SHARE and
    reach the rows by broadcast. salt deals a key's rows to its parts: it must differ
    between them and come out the same when a task is repeated. total: the number of rows
    or more, if known.
    """
    if total is None:
        total = named.agg(F.sum("__n")).first()[0] or 0
    parts = F.ceil(F.col("__n") * HOT_SHARE / F.lit(max(total, 1))).cast("long")
    hot = F.broadcast(named.select(key, parts.alias("__parts")).filter("__parts > 1"))
    left = rows.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(salt, F.col("__parts")), F.lit(0).cast("long"))).drop("__parts")
    right = named.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))).drop("__n")
    return left.join(right, [key, "__salt"]).drop("__salt")


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add exclusive running totals in a total order without gathering rows in one task.

    Rows are dealt by range and written once; only one row of totals per range
    partition reaches the driver, and comes back as a broadcast of that size.
    A rank is the running total of ``F.lit(1)``.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    keys = {f"__o{i}": i for i in range(len(order))}
    dealt = df.withColumns(values).repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    dealt = materialise(dealt, "running")
    totals = {r["__p"]: r for r in dealt.groupBy("__p").agg(*[F.sum(v).alias(v) for v in values]).collect()}
    rows, so_far = [], [0] * len(values)
    for p in sorted(totals):
        rows.append((p, *so_far))
        so_far = [a + (totals[p][v] or 0) for a, v in zip(so_far, values, strict=True)]
    names = ["__q", *[f"__b{i}" for i in range(len(values))]]
    kind = {v: dealt.schema[v].dataType.typeName() for v in values}
    kinds = ["int", *["double" if kind[v] == "double" else "long" for v in values]]
    base = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(base), F.col("__p") == F.col("__q"))
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.col(f"__b{i}") + F.sum(f"__v{i}").over(w) - F.col(f"__v{i}"))
    return out.drop("__p", "__q", *values, *names[1:], *keys)


def shielded(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but those needed under names that clash with nothing; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*[c if c in needed else f"__x{i}" for i, c in enumerate(docs.columns)])


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, over many tasks, and until another owner asks for one.

    So a worker that has gone on to another operator's work does not hold what the one
    before has learnt; its memory goes back to the system, which the allocator would not
    do by itself.
    """
    held = sys.modules.setdefault("_chronoloom_worker", types.ModuleType("_chronoloom_worker")).__dict__
    if held.get("owner") != owner:
        held["owner"], held["cache"] = owner, {}
        give_back()
    return held["cache"]


def give_back() -> None:
    """Hand memory that nothing refers to back to the system: Python's own, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, by a worker that forgets other owners' caches first and gives its batches' memory back at the end.

    A worker may wait a minute for its next task, which may come when others need the memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column, empty where it is null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def utf8_of(column: pa.Array) -> pa.Array:
    """utf8() of a batch's column of texts, in place: so a task that hands the texts on gets them once."""
    out = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return out.fill_null(b"") if out.null_count else out
