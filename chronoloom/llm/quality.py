"""Quality rules and a hashed n-gram likelihood ratio.

Base rules reject documents that are too short or repeat themselves. The rest is judged
by the log-likelihood ratio of two multinomials over hashed n-grams, one counted on
trusted documents (labels with quality 1 and none with 0) and one on the whole corpus, divided
by the document's number of n-grams. N-grams are single and paired tokens; a token is a
run of letters, digits and non-ASCII bytes, or a run of other signs.

Counts cover every document and the ratio table has 2^15 entries whatever the corpus.
The threshold is the one that best parts the labelled documents of either quality; it is
read off a score histogram over all of them, so that every document's verdict follows
from its text alone.

Edge cases: null and empty texts have no words and fail the base rules; repeated rows are
judged alike and count each time; without trusted documents, or without labels of both
kinds, only the base rules decide; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_IDS, materialise, shielded, table, thrifty, utf8, utf8_of

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BUCKET_BITS = 15
SLICES = 32
#: Text that is turned to n-grams at once; a longer document is one piece.
CHUNK_BYTES = 1 << 20
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Steps of the score histogram that the threshold is read from.
STEPS_PER_UNIT = 200

_BASE = 0x9E3779B97F4A7C15 | 1
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_KIND[[32, *range(9, 14)]] = 0


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    spaces = len(text) - sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  a cache
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if known.get("n", 0) < n:
        n = max(n, CHUNK_BYTES + 4096)
        known["n"] = n
        known["up"], known["down"] = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return known["up"], known["down"]


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin (one entry more than texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = _KIND[data]
    before, after = np.r_[np.uint8(0), kind[:-1]], np.r_[kind[1:], np.uint8(0)]
    start = np.flatnonzero((kind != 0) & (kind != before))
    end = np.flatnonzero((kind != 0) & (kind != after)) + 1
    up, down = _powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    return (total[end] - total[start]) * down[start], np.searchsorted(start, begins)


def ngram_buckets(texts: list[bytes], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all single tokens, of all pairs inside a text (-1 where a text ends), and the texts' beginnings."""
    hashes, at = token_hashes(texts)
    shift = np.uint64(64 - bits)
    single = (_mixed(hashes) >> shift).astype(np.int64)
    pairs = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        pairs[:-1] = (_mixed(hashes[:-1] * np.uint64(3) + _mixed(hashes[1:])) >> shift).astype(np.int64)
    last = at[1:][at[1:] > at[:-1]] - 1
    pairs[last] = -1
    return single, pairs, at


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about CHUNK_BYTES, each with its first number."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_BYTES:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_py() for x in column]


def ngram_counts(docs: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each bucket occurs in all texts.

    Every task sums its own table and hands it on in slices; each slice is summed as its
    parts stream in. The driver gets one table.
    """
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in pieces(_texts(batch.column(0))):
                single, pairs, _ = ngram_buckets(texts, bits)
                total += np.bincount(single, minlength=len(total)) + np.bincount(pairs[pairs >= 0], minlength=len(total))
        if total.any():
            parts = [total[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0), batch.column(1), strict=True):
                sums.setdefault(k.as_py(), np.zeros(width, np.int64))[:] += np.frombuffer(part.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema, out = "slice int, counts binary", np.zeros(1 << bits, np.int64)
    slices = docs.select(utf8().alias("text")).mapInArrow(thrifty("quality", count), schema)
    for row in slices.repartitionById(SLICES, F.col("slice")).mapInArrow(thrifty("quality", add), schema).collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out


def log_ratios(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """log of the smoothed trusted share over the smoothed corpus share, by bucket; zero without trusted text."""
    if not trusted.any():
        return np.zeros(len(corpus))
    shares = [(x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)) for x in (trusted, corpus)]
    return np.log(shares[0]) - np.log(shares[1])


def judge(texts: list[bytes], ratios: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The base measures (a row each) and the length-normalised ratios of texts."""
    measures = np.array([base_measures(t) for t in texts], np.int64).reshape(-1, 5)
    score = np.zeros(len(texts))
    for first, part in pieces(texts):
        single, pairs, at = ngram_buckets(part, bits)
        values = ratios[single] + np.where(pairs >= 0, ratios[pairs], 0.0)
        # each text by itself, so that equal texts score alike wherever they stand
        sums = np.array([values[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)])
        score[first : first + len(part)] = sums / np.maximum(2 * np.diff(at) - 1, 1)
    return measures, np.round(score, 9)


def failed(n_words, n_repeat_words):
    """The base rules, over columns or arrays."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, the base measures and the ratio of every document, in the input's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, score = judge(_texts(batch.column(1)), ratios)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in measures.T), pa.array(score)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["long"] * 5, "double"]
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(thrifty("quality", run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def best_threshold(scores: DataFrame, labels: DataFrame) -> float | None:
    """The score from which on documents are kept: the best balanced accuracy over labelled documents that pass the base rules.

    Of equally good steps the middle of the widest run is taken, so that either side keeps a margin.
    """
    step = F.floor(F.col("score") * STEPS_PER_UNIT)
    rows = scores.filter(~F.col("base_failed")).join(labels, "doc_id").groupBy(step.alias("step"), "good").count().collect()
    good, bad = ({r["step"]: r["count"] for r in rows if r["good"] == g} for g in (True, False))
    if not good or not bad:
        return None
    steps = range(min(*good, *bad), max(*good, *bad) + 2)
    below_good = below_bad = 0
    found = []
    for s in steps:  # keep from step s on
        found.append((below_bad / sum(bad.values()) - below_good / sum(good.values()), s))
        below_good, below_bad = below_good + good.get(s, 0), below_bad + bad.get(s, 0)
    best = max(x for x, _ in found)
    runs, run = [], []
    for x, s in found:
        if x == best:
            run.append(s)
        elif run:
            runs.append(run)
            run = []
    run = max([*runs, run], key=len)
    return run[len(run) // 2] / STEPS_PER_UNIT


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id and good: whether all its quality labels are 1; documents without a quality label are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def corpus_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """The ratio table. Up to BROADCAST_IDS trusted ids are broadcast, so that no text moves; beyond it ids and texts meet in one shuffle."""
    ids = good.filter("good").select("doc_id")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    trusted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return log_ratios(ngram_counts(trusted), ngram_counts(docs))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float | None]:
    """The ratio table and the threshold."""
    good = trusted_labels(labels)
    ratios = corpus_ratios(docs, good)
    scores = scored(docs, ratios).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    return ratios, best_threshold(scores, good)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's base measures, score, base_failed and kept."""
    good = trusted_labels(labels)
    scores = scored(docs, corpus_ratios(docs, good))
    scores = materialise(scores.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))), "quality")
    threshold = best_threshold(scores, good)
    passed = F.lit(True) if threshold is None else F.col("score") >= threshold
    return scores.withColumn("kept", ~F.col("base_failed") & passed).withColumn("threshold", F.lit(threshold).cast("double"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns.

    The verdict follows from a document's text, so it is taken again in place, with the
    ratios and the threshold already known: no text moves for it.
    """
    (ratios, threshold), inner = fitted(docs, labels), shielded(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, score = judge(_texts(utf8_of(batch.column(at))), ratios)
            kept = ~failed(measures[:, 0], measures[:, 4])
            if threshold is not None:
                kept &= score >= threshold
            yield batch.filter(pa.array(kept, pa.bool_()))

    at = inner.columns.index("text")
    return inner.mapInArrow(thrifty("quality", run), inner.schema).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")
