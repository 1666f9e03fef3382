"""Vectors and histograms as array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

NORM_FLOOR = 1e-12
#: Bytes of the query vectors that are broadcast at once.
QUERY_BYTES = 64 << 20
#: Queries and documents of one matrix product, candidates that a task holds, over all its blocks of queries, before it keeps the best, and places that scores are told apart by.
BLOCK_QUERIES, BLOCK_DOCUMENTS, HELD, PLACES = 1024, 2048, 1 << 21, 12
BINS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(NORM_FLOOR))
    return F.transform(v.cast("array<double>"), lambda x: x / norm)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda n, x: n + x) / F.size(a)


@F.pandas_udf(ArrayType(LongType()))
def difference_histogram(a: pd.Series, b: pd.Series) -> pd.Series:
    """How often each of the 256 possible differences stands between two arrays of 8-bit samples; null where one is missing.

    All samples of a batch are counted at once, each under its row and its difference.
    """
    sizes = [min(len(x), len(y)) if x is not None and y is not None else -1 for x, y in zip(a, b, strict=True)]
    known = [i for i, n in enumerate(sizes) if n >= 0]
    out = np.empty(len(a), object)
    if known:
        rows = np.repeat(np.arange(len(known)), [sizes[i] for i in known])
        of = lambda s: np.concatenate([np.asarray(s.iloc[i][: sizes[i]], np.int64) for i in known])
        counts = np.bincount(rows * BINS + np.abs(of(a) - of(b)), minlength=len(known) * BINS).reshape(-1, BINS)
        for i, row in zip(known, counts, strict=True):
            out[i] = row
    return pd.Series(out, index=a.index)


def histogram_mean(histogram: Column) -> Column:
    """The mean difference, 0 to 1, of a histogram of differences."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda n, x: n + x)
    weighed = F.aggregate(F.transform(histogram, lambda x, i: x.cast("long") * i), F.lit(0).cast("long"), lambda n, x: n + x)
    return F.when(total > 0, weighed / (total * 255))


class Best:
    """The k best documents of each query among those seen so far; ties go to the lower id.

    parts: how many such blocks of queries a task has, which share the room for candidates.
    """

    def __init__(self, queries: int, k: int, parts: int = 1):
        self.k, self.least, self.room = k, np.full(queries, -np.inf), HELD // parts
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def see(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries, documents). Only what may be among the k best of these documents too is held."""
        least = self.least
        if scores.shape[1] > self.k:
            ranked = np.where(np.isnan(scores), -np.inf, scores)
            ranked.partition(-self.k, axis=1)
            least = np.maximum(least, ranked[:, -self.k])
        query, document = np.nonzero(scores >= least[:, None])
        self.held.append((query, scores[query, document], ids[document]))
        self.size += len(query)
        if self.size > self.room:
            self.settle()

    def settle(self) -> None:
        """Keep the best only, and know from which score on another may be one of them."""
        query, score, ids = (np.concatenate(x) for x in zip((self.query, self.score, self.ids), *self.held, strict=True))
        order = np.lexsort((pd.factorize(ids, sort=True)[0], -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(len(self.least)))
        kept = np.arange(len(query)) - first[query] < self.k
        self.query, self.score, self.ids, self.held, self.size = query[kept], score[kept], ids[kept], [], 0
        last = np.searchsorted(self.query, np.arange(len(self.least)), "right") - 1
        full = np.bincount(self.query, minlength=len(self.least)) >= self.k
        self.least[full] = self.score[last[full]]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), NORM_FLOOR)


def top_k(documents: DataFrame, queries: DataFrame, k: int, doc_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine top k of documents for each query (query_id, query_vector); equal scores, to 12 places, go by document id.

    Queries are a stated set. All that QUERY_BYTES hold meet the documents in one scan, as
    matrix products of a batch with a block of queries; a task keeps k a query, and the tasks'
    best meet in a shuffle. Rows without a vector are left out.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark, kept = documents.sparkSession, documents.select(F.col(doc_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    kind, asked_kind = documents.schema[doc_id].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {asked_kind}, `{doc_id}` {kind}, score double"
    out = spark.createDataFrame([], schema)
    for ids, vectors in _query_blocks(queries) if k else ():
        shared = spark.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, matrix = shared.value
            begins = range(0, len(matrix), BLOCK_QUERIES)
            parts, id_type = [(at, Best(len(matrix[at : at + BLOCK_QUERIES]), k, len(begins))) for at in begins], None
            for batch in batches:
                id_type = batch.column(0).type
                for at in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                    part = batch.slice(at, BLOCK_DOCUMENTS)
                    if pc.any(pc.not_equal(pc.list_value_length(part.column(1)), matrix.shape[1])).as_py():
                        raise ValueError(f"a vector is not of dimension {matrix.shape[1]}")
                    found = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    names = np.array(part.column(0).to_pylist(), object)
                    for first, best in parts:
                        scores = matrix[first : first + BLOCK_QUERIES] @ found.T
                        best.see(np.round(scores, PLACES, out=scores), names)
            for first, best in parts:
                best.settle()
                if len(best.query):
                    columns = [pa.array([asked[first + q] for q in best.query.tolist()], asked_type), pa.array(best.ids.tolist(), id_type), pa.array(best.score)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", doc_id, "score"])

        asked_type = to_arrow_type(queries.schema["query_id"].dataType)
        out = out.unionByName(kept.mapInArrow(scan, schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), doc_id)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The queries' ids and unit vectors, so many at once as QUERY_BYTES hold."""
    ids, vectors = [], []
    for r in queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).filter(F.col("v").isNotNull()).toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["v"])
        if len({len(vectors[0]), len(vectors[-1])}) > 1:
            raise ValueError("queries of several dimensions")
        if 8 * len(vectors) * len(vectors[0]) >= QUERY_BYTES:
            yield ids, unit(np.array(vectors))
            ids, vectors = [], []
    if ids:
        yield ids, unit(np.array(vectors))
