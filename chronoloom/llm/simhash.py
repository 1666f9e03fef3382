"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits its variants within half the radius, variants are
shuffled, and fingerprints that meet in a variant are verified and linked. For radius
3 half is one bit on one side and two on the other, and parity says which side: at an
odd distance exactly one of two fingerprints has an odd number of set bits, so

    even ones emit their 64 one-bit variants,
    odd ones emit themselves, their 64 one-bit variants, and two-bit variants whose
    bits lie in the same half of the word.

Any three bits have two in the same half, so at distance 3 the odd fingerprint flips
those and the even one the third. At distance 1 the even one reaches the odd one itself;
at distance 2 both flip one bit. That is every link, with 64 or 1,057 variants each.

A variant travels as its fingerprint and a two-byte mask number, many to a row. Where k
fingerprints meet, they become a star round one that flipped at most one bit (k - 1
links; two that flipped two bits each need not be near), and each task passes on a
spanning forest of its links only. So no group is ever expanded into pairs.

Copies and large groups are hot keys (a fingerprint, a root); joins on them split a key
that holds more than a thousandth of the rows.

The radius is in bits of the fingerprint: copies with a few words changed are linked only
if no more than three bits flip, which for short texts is about every other one.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated
rows share a fingerprint; null ids are ignored for a component's smallest id; an empty
table gives an empty result; very long texts are counted in bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_IDS, materialise, shielded, spread_join, table, thrifty, utf8
from chronoloom.llm.graph import stars

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Variants that one bucket holds on average; their number follows from the fingerprints'.
BUCKET_VARIANTS = 2_000_000
#: Fingerprints whose variants a task makes at once: so many for every 64 buckets, within these bounds. A bucket's share of a
#: block travels as one row; beyond the upper bound its variants thin out to at most 12 bytes each.
BLOCK, MOST_BLOCK = 4096, 16_384
#: Shingles whose bits are counted at once.
STEP = 1 << 18


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's three-word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(words, islice(words, 1, None), islice(words, 2, None)))
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    while hashes := [digest(s, SEED) for s in islice(shingles, STEP)]:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of every document and fp, its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], [*keep, "fp"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(utf8().alias("__text"), *keep).mapInArrow(thrifty("simhash", run), f"{kinds}, fp long")


def masks() -> tuple[np.ndarray, int]:
    """All masks: none, one bit, two bits of the same half; and how many of them flip at most one."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    return np.array([0, *one, *two], np.uint64), 65


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt_variants(fps: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The variants of fingerprints by bucket: fingerprints, how many masks each, and the masks' numbers."""
    every, near = masks()
    odd = np.bitwise_count(fps) & 1 == 1
    for part, first, last in ((fps[odd], 0, len(every)), (fps[~odd], 1, near)):
        numbers = np.arange(first, last, dtype=np.uint16)
        where = (mixed(part[:, None] ^ every[None, first:last]) % np.uint64(buckets)).astype(np.uint32).ravel()
        order = np.argsort(where, kind="stable")  # within a bucket by fingerprint
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        rows = order // len(numbers)
        for b in range(buckets):
            if ends[b] < ends[b + 1]:
                own = order[ends[b] : ends[b + 1]]
                held, counts = np.unique(rows[ends[b] : ends[b + 1]], return_counts=True)
                yield b, part[held].tobytes(), counts.astype(np.uint16).tobytes(), numbers[own % len(numbers)].tobytes()


def met(fps: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints whose variants are equal: a spanning forest of their stars."""
    every, near = masks()
    variants = fps ^ every[numbers]
    order = np.argsort(variants)
    variants = variants[order]
    same = variants[1:] == variants[:-1]
    hit = np.zeros(len(variants), bool)
    hit[1:] |= same
    hit[:-1] |= same
    order, variants = order[hit], variants[hit]
    fps, far = fps[order], numbers[order] >= near
    order = np.lexsort((fps, far, variants))
    fps, far, variants = fps[order], far[order], variants[order]
    begins = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]]) if len(variants) else np.zeros(0, np.int64)
    first = np.repeat(begins, np.diff(np.r_[begins, len(variants)]))
    a, b = fps[first], fps
    good = ~far[first] & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[good], b[good]], 1), axis=0)
    return forest(pairs)


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs that join what earlier ones have not."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    above, kept = list(range(len(nodes))), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for i, (a, b) in enumerate(flat.reshape(-1, 2).tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept, 0], pairs[kept, 1]


def links(nodes: DataFrame, known: int) -> DataFrame:
    """(a, b) over distinct fingerprints fp (known: their number): enough links to connect all that are near."""
    buckets = max(1, -(-known * 560 // BUCKET_VARIANTS))
    block = min(max(BLOCK, BLOCK * buckets // 64), MOST_BLOCK)
    binary = pa.binary()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), block):
                columns = list(zip(*dealt_variants(fps[at : at + block], buckets), strict=True))
                if columns:
                    arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, binary) for c in columns[1:])]
                    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "fps", "counts", "numbers"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, numbers = [], []
        for batch in batches:
            for f, c, n in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                fps.append(np.repeat(np.frombuffer(f.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint16)))
                numbers.append(np.frombuffer(n.as_py(), np.uint16))
        if fps:
            a, b = met(np.concatenate(fps), np.concatenate(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    variants = nodes.select("fp").mapInArrow(thrifty("simhash", emit), "bucket int, fps binary, counts binary, numbers binary")
    # one bucket is one partition: equal variants meet in one task
    return variants.repartitionById(buckets, F.col("bucket")).mapInArrow(thrifty("simhash", meet), "a long, b long")


def grouped(rows: DataFrame, ident: str) -> DataFrame:
    """rows (fp and others) with group_id: the smallest ident reachable over links."""
    nodes = materialise(rows.groupBy("fp").agg(F.min(ident).alias("first"), F.count("*").alias("copies")), "fingerprints")
    known, total = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    linked = stars(links(nodes, known))
    rooted = nodes.join(linked, nodes["fp"] == linked["a"], "left").select("fp", "first", "copies", F.coalesce("b", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("group_id"), F.count("*").alias("__n"))
    named = spread_join(rooted.select("fp", "copies", "root"), least, "root", F.xxhash64("fp"), known)
    named = materialise(named.select("fp", "group_id", F.col("copies").alias("__n")), "named")
    return spread_join(rows, named, "fp", F.monotonically_increasing_id(), total)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(fingerprints(table(spark, sf_dir, "documents"), "doc_id"), "simhash")
    return grouped(rows, "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("group_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each component the row with the smallest id (null last) stays.

    Texts are written once, with a row number, and the decision moves short rows only. Up
    to BROADCAST_IDS dropped rows are broadcast and the texts filtered in place; beyond
    it, row numbers and texts meet in one shuffle.
    """
    inner = shielded(docs, "doc_id", "text")
    numbered = materialise(inner.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = fingerprints(numbered, "doc_id", "__row")
    rows = materialise(rows.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("ident")), "simhash")
    dropped = grouped(rows, "ident").filter(F.col("ident") != F.col("group_id")).select(F.col("ident")["__row"].alias("__dropped"))
    dropped = materialise(dropped, "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped.hint("merge")
    return numbered.join(dropped, numbered["__row"] == dropped["__dropped"], "left_anti").select(*inner.columns).toDF(*docs.columns)
