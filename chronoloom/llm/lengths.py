"""Token counts: an exact length histogram.

Every document is encoded whole and only its length is kept: tasks count lengths,
lengths are summed, and running totals over the histogram answer, for every context
limit, how many tokens stay when documents are cut there, how many documents reach
it, and any quantile. The histogram has one row per distinct length, and nothing
else crosses the network.

Edge cases: null and empty texts have length 0; repeated rows count each time; an
empty table gives an empty histogram; very long texts are encoded word by word, so
their cost is linear.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, running, table, utf8, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space that the vocabulary's pattern knows besides the ASCII kind; texts with it are encoded in one go.
RARE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: White space that the vocabulary's pattern would recurse over too deeply.
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{10000,}")
#: White space and the word after it: no token of the vocabulary crosses from a word into the white space that follows.
CHUNK = re.compile("[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
#: Words that a worker remembers at most; beyond it, it starts afresh.
REMEMBERED = 500_000


def byte_encoding(path: str | None = None):
    """The byte-level BPE in a rank file, kept by the worker."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    cache = worker_cache("lengths")
    if ("encoding", path) not in cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["encoding", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["encoding", path]


def coded_length(text: str, encoding) -> int:
    """The number of tokens of a text. A long run of white space is one piece, but for its last character before a word: it is coded without the pattern."""
    total = at = 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def token_length(text: str, encoding, known: dict[str, int]) -> int:
    """The number of tokens of a whole text; known keeps chunks' lengths."""
    if RARE_SPACE.search(text):
        return coded_length(text, encoding)
    total = 0
    for chunk, times in Counter(CHUNK.findall(text)).items():
        n = known.get(chunk)
        if n is None:
            if len(known) >= REMEMBERED:
                known.clear()
            n = coded_length(chunk, encoding)
            if len(chunk) <= 64:
                known[chunk] = n
        total += n * times
    return total


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs) as each task has counted them; docs needs text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known, lengths = byte_encoding(path), worker_cache("lengths").setdefault("chunk lengths", {}), Counter()
        for batch in batches:
            for value in batch.column(0):
                lengths[token_length(value.as_py().decode("utf-8", "replace"), encoding, known)] += 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(lengths), pa.int64()), "n_docs": pa.array(list(lengths.values()), pa.int64())})

    return docs.select(utf8().alias("text")).mapInArrow(count, "length long, n_docs long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encoded_lengths(docs, path).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """For each length L of a histogram, as a context limit: what lies at or above it and what cutting at it keeps.

    docs_at_least and tokens_at_least count documents of L tokens or more;
    truncated_tokens is the total when every document is cut to L; quantile is the
    share of documents of at most L tokens. Limits between two lengths follow from the
    next length above: kept(m) = kept(L) - (L - m) * docs_at_least(L).
    """
    lengths = materialise(lengths, "histogram")
    tokens = F.col("length") * F.col("n_docs")
    docs, total = lengths.agg(F.sum("n_docs"), F.sum(tokens)).first()
    below = running(lengths, [F.col("length")], {"docs_below": F.col("n_docs"), "tokens_below": tokens})
    at_least = F.lit(docs or 0).cast("long") - F.col("docs_below")
    return below.select(
        "length", "n_docs", at_least.alias("docs_at_least"), (F.lit(total or 0).cast("long") - F.col("tokens_below")).alias("tokens_at_least"),
        (F.col("tokens_below") + F.col("length") * at_least).alias("truncated_tokens"),
        ((F.col("docs_below") + F.col("n_docs")) / F.lit(docs or 1)).alias("quantile"),
    )


def truncated_total(table_of_limits: DataFrame, limit: int) -> int:
    """Tokens that stay when every document is cut to limit."""
    above = table_of_limits.filter(F.col("length") >= limit).orderBy("length").first()
    if above is None:
        return table_of_limits.agg(F.sum(F.col("length") * F.col("n_docs"))).first()[0] or 0
    return above["truncated_tokens"] - (above["length"] - limit) * above["docs_at_least"]


def length_quantile(table_of_limits: DataFrame, share: float) -> int | None:
    """The least length that at least this share of the documents do not exceed."""
    return table_of_limits.filter(F.col("quantile") >= share).agg(F.min("length")).first()[0]


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(table(spark, sf_dir, "documents")))
