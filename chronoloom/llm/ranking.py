"""Ranked lexical search over a bit-sliced impact index.

Documents are taken in blocks, as a task reads them; bit positions follow ascending
document ids. A row of the index is a term in a block: which documents hold it, and the
bits of its impact in each, one slice a bit, the slices one after the other. Rows of a block
are in order of their terms. One more row a block, without a term, names its documents. An
impact is the part of a term's score that hangs on the document, of 20 bits.

A search keeps the rows of its terms, counts documents over them, and brings each block's
rows together. There an impact is multiplied by its term's weight, and impacts are added
over an item's terms, by carries between slices: a whole block of documents is
added with each machine instruction's word of 64. The best documents are found from the most
significant slice down: documents with the slice's bit set come before those without.
A block gives each item's best; the best over all blocks follow.

Neither building nor searching gathers a term's rows in one task. Items are taken in blocks
of at most ITEMS items and about TERMS distinct terms, so that what a search broadcasts
and what a block holds are bounded; all documents are scored for every item.

Edge cases: null and empty texts, and texts without a term, are not in the index; an item
without terms finds nothing; repeated rows are documents of their own and tied; null ids
come after all others; a very long text may be a block by itself; of no documents the index
is empty. An item that stands in several rows is searched once for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import materialise, table, utf8

#: Letters and digits of ASCII, lower-cased, and all beyond it; every other byte parts terms.
TERM_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())
IMPACT_BITS = 20
#: Documents and bytes of a block at most, but for a single longer document.
BLOCK_DOCS, BLOCK_BYTES = 8192, 16 << 20
ITEMS, TERMS = 512, 4096
BEST = 10
INDEX = "block long, term string, n long, places binary, slices binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TERM_BYTES).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, repeats included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py()))
                rows, terms = rows + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"rows": [rows], "terms": [terms]})

    found = docs.select(utf8().alias("text")).mapInArrow(count, "rows long, terms long").agg(F.sum("rows"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def damping(n: int, rows: int, terms: int) -> int:
    """A document's length, of n terms, against the mean, in hundredths."""
    return 100 - 75 + (75 * n * rows) // terms


def weight(df: int, rows: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Block:
    """Documents on their way into the index."""

    def __init__(self, rows: int, terms: int):
        self.rows, self.terms = rows, terms
        self.keys: list[pa.Array] = []
        self.numbers, self.found, self.impacts, self.sizes, self.bytes = Numbers(), [], [], [], 0

    def add(self, key: pa.Array, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        held = Counter(words)
        tf = np.fromiter(held.values(), np.int64, len(held))
        self.found.append(np.fromiter(map(self.numbers.__getitem__, held), np.int64, len(held)))
        self.impacts.append(1_000_000_000 * tf // (1000 * tf + 8 * damping(len(words), self.rows, self.terms)))
        self.keys.append(key)
        self.sizes.append(len(held))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def index(self, block: int) -> pa.RecordBatch:
        keys = pa.concat_arrays(self.keys)
        order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        term, place = rank[np.concatenate(self.found)], np.repeat(position, self.sizes)
        by_term = np.argsort(term << 16 | place)
        term, place, impact = term[by_term], place[by_term], np.concatenate(self.impacts)[by_term]
        n = np.bincount(term, minlength=len(names))
        first = np.cumsum(n) - n
        bits, slice_bytes = IMPACT_BITS * n, -(-IMPACT_BITS * n // 8)
        start = np.cumsum(slice_bytes) - slice_bytes
        at = 8 * start[term] + np.arange(len(term)) - first[term]
        flat = np.zeros(8 * int(slice_bytes.sum()), np.uint8)
        for i in range(IMPACT_BITS):
            flat[at + i * n[term]] = impact >> i & 1
        slices = np.packbits(flat, bitorder="little")
        del flat, bits
        columns = [
            pa.array(np.full(len(names) + 1, block)), pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(names, pa.binary()).cast(pa.string())]), pa.array(np.concatenate([[len(keys)], n])),
            binaries(place.astype("<u2"), 2 * n), binaries(slices, slice_bytes),
            pa.concat_arrays([pa.ListArray.from_arrays([0, len(keys)], keys.take(pa.array(order))), pa.nulls(len(names), pa.list_(keys.type))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "places", "slices", "keys"])


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One buffer cut into binary values of these lengths in bytes, after an empty one."""
    ends = np.concatenate([[0, 0], np.cumsum(lengths)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths) + 1, [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def build(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index of all documents; docs has key and text. What it returns should be written once and read by searches."""
    rows, terms = totals(docs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, open_ = TaskContext.get().partitionId() << 33, Block(rows, terms)
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                open_.add(batch.column(0).slice(i, 1), text.as_py())
                if open_.full():
                    yield open_.index(block)
                    block, open_ = block + 1, Block(rows, terms)
        if open_.keys:
            yield open_.index(block)

    return docs.select(key, utf8().alias("__text")).mapInArrow(run, f"{INDEX}, keys array<{kind}>")


class Adder:
    """Numbers of many documents, bit-sliced: slice i holds bit i of each. Carries stay beside the sums until all is added."""

    def __init__(self, height: int, width: int):
        self.sums, self.carries = np.zeros((height, width), np.uint64), np.zeros((height, width), np.uint64)

    def add(self, slices: np.ndarray, shift: int = 0) -> None:
        """Add slices times 2^shift, to all documents at once."""
        low, high = slice(shift, shift + len(slices)), slice(shift + len(slices), None)
        s, c = self.sums, self.carries
        half, over = s[shift:] ^ c[shift:], s[shift:] & c[shift:]
        over[: len(slices)] |= half[: len(slices)] & slices
        s[low] = half[: len(slices)] ^ slices
        s[high] = half[len(slices) :]
        c[shift] = 0
        c[shift + 1 :] = over[:-1]

    def total(self) -> np.ndarray:
        """The sums, after the carries have gone up."""
        out, carry = np.empty_like(self.sums), np.zeros_like(self.sums[0])
        for i, (s, c) in enumerate(zip(self.sums, self.carries, strict=True)):
            half = s ^ c
            out[i] = half ^ carry
            carry = s & c | half & carry
        return out


def times(slices: np.ndarray, factor: int) -> np.ndarray:
    """Bit-sliced numbers times a factor, by one addition for each of its bits."""
    adder = Adder(max(1, len(slices) + factor.bit_length()), slices.shape[1])
    for shift in range(factor.bit_length()):
        if factor >> shift & 1:
            adder.add(slices, shift)
    return adder.total()


def dense(places: bytes, slices: bytes, docs: int) -> np.ndarray:
    """A row's slices over all documents of its block, 64 to a word."""
    at = np.frombuffer(places, "<u2")
    bits = np.unpackbits(np.frombuffer(slices, np.uint8), count=IMPACT_BITS * len(at), bitorder="little").reshape(IMPACT_BITS, len(at))
    wide = np.zeros((IMPACT_BITS, -(-docs // 64) * 64), np.uint8)
    wide[:, at] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def best(slices: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place, number) of the k largest numbers above 0, of equal ones those of the first places."""
    open_, sure = np.bitwise_or.reduce(slices, axis=0), np.zeros_like(slices[0])
    taken = 0
    for bits in slices[::-1]:
        set_ = open_ & bits
        n = int(np.bitwise_count(set_).sum())
        if taken + n > k:
            open_ = set_
        else:
            sure |= set_
            open_ &= ~bits
            taken += n
            if taken == k:
                break
    places = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if taken < k:
        tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
        places = np.concatenate([places, tied[: k - taken]])
    bits = slices[:, places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
    numbers = (bits << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0)
    return sorted(zip(places.tolist(), numbers.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def item_blocks(items: DataFrame, key: str) -> Iterator[list[tuple[object, Counter]]]:
    """Items with terms as (id, their terms' counts), so many at once that a search of them is bounded."""
    block, known = [], set()
    for r in items.select(key, utf8().alias("__text")).toLocalIterator():
        held = Counter(t.decode("utf-8", "replace") for t in terms_of(bytes(r["__text"])))
        if not held:
            continue
        if block and (len(block) >= ITEMS or len(known | held.keys()) > TERMS):
            yield block
            block, known = [], set()
        block.append((r[key], held))
        known |= held.keys()
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, key: str = "item_id", k: int = BEST) -> DataFrame:
    """(key, rank, doc, score): each item's k best documents. index as from build(), written and read again; items has key and text."""
    spark = index.sparkSession
    rows = index.filter(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0
    kind, doc = items.schema[key].dataType.simpleString(), index.schema["keys"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item long, key {kind}, doc {doc}, score long")
    first = 0
    for block in item_blocks(items, key):
        out = out.unionByName(_found(index, block, rows, first, k, kind, doc))
        first += len(block)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("key").alias(key), "rank", "doc", "score")


def _found(index: DataFrame, items: list[tuple[object, Counter]], rows: int, first: int, k: int, kind: str, doc: str) -> DataFrame:
    """Each block's best documents for each of the items, which are numbered from first."""
    spark = index.sparkSession
    names = sorted({t for _, held in items for t in held})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in names], "term string"))
    df = {r["term"]: r["df"] for r in index.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = {t: weight(n, rows) for t, n in df.items()}
    shared = spark.sparkContext.broadcast((items, weights))
    names_out = ["item", "key", "doc", "score"]

    def run(group: pa.Table) -> pa.Table:
        items, weights = shared.value
        terms = group["term"].to_pylist()
        keys = group["keys"][terms.index(None)].values
        held = {t: i for i, t in enumerate(terms) if weights.get(t)}
        places, slices, ready, out = group["places"], group["slices"], {}, []

        def impacts(term: str) -> np.ndarray:
            if term not in ready:
                at = held[term]
                ready[term] = times(dense(places[at].as_py(), slices[at].as_py(), len(keys)), weights[term])
            return ready[term]

        for number, (item, asked) in enumerate(items, first):
            here = [(t, n) for t, n in asked.items() if t in held]
            if not here:
                continue
            most = sum(weights[t] * n for t, n in here) << IMPACT_BITS
            adder = Adder(most.bit_length(), -(-len(keys) // 64))
            for term, n in here:
                for shift in range(n.bit_length()):
                    if n >> shift & 1:
                        adder.add(impacts(term), shift)
            out += [(number, item, at, score) for at, score in best(adder.total(), k)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        chosen = keys.take(pa.array(columns[2], pa.int64()))
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], schema_key), chosen, pa.array(columns[3], pa.int64())], names=names_out)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"item long, key {kind}, doc {doc}, score long"
    schema_key = to_arrow_type(spark.createDataFrame([], schema).schema["key"].dataType)
    met = index.join(wanted.withColumn("__wanted", F.lit(True)), "term", "left").filter(F.col("__wanted") | F.col("term").isNull()).drop("__wanted")
    return met.select("block", "term", "places", "slices", "keys").groupBy("block").applyInArrow(run, schema)


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    index = materialise(build(table(spark, sf_dir, "documents")), "impact-index", "zstd")
    found = search(index, table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), sizes AS (SELECT r, count(*) AS n FROM words GROUP BY r
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), held AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), asked AS (
    SELECT item_id, q, term, count(*) AS times FROM (
        SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, totals GROUP BY term
), scores AS (
    SELECT item_id, q, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
