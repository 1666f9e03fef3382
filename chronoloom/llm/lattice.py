"""Language-model scoring by the subword lattice.

The pieces of an existing vocabulary and their scores weight all segmentations of a
text; a forward recursion in log space sums them to the text's marginal probability. No
piece crosses white space, so a text's lattice falls apart into its words' lattices: a
word is a piece that begins words and any number of pieces that go on, and its marginal
is computed once for all its occurrences.

The vocabulary's scores are merge ranks; rank r begins with a weight as 1 / (r + 3).
Forward and backward recursions over all training words then give every piece its
expected count, which replaces the weight (an EM step; SMOOTHING pseudo-counts of the
old weights stay, so that every byte keeps one). A text's end is a token with its own
share. ``score`` is the text's marginal over the vocabulary's pieces, and nothing else.

``mixed_score`` is a second model beside it, whose lattice also holds one arc for each
whole training word, with its discounted corpus share; what the discount frees weighs
the pieces:

    p(word) = (max(count - 0.75, 0) + 0.75 * distinct words * marginal over pieces) / training words

Shares and marginals sum to one over all words, so both are proper log probabilities.

Plan: a task cuts its documents into blocks of some megabytes and keeps each block's
distinct words once, so that what is shuffled is words per block, not occurrences.
Words meet by hash, get their corpus count and marginal, and go back to their blocks,
one block to a task, where documents are summed. All training counts follow from all documents. Lists of
words and numbers travel compressed, many to a row.

Edge cases: null and empty texts are the end token alone; repeated rows count each
time; null ids train; without training documents the vocabulary's own weights hold; bytes
outside the vocabulary have byte pieces, so no text is impossible; very long words are
walked piece by piece, at linear cost; empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, table, utf8

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_FOLD = 5, 1
BLOCK_BYTES = 16 << 20
#: Word rows that one task brings together on average.
WORDS_A_TASK = 200_000
#: Blocks whose entries of one word come to one task; beyond it words are dealt by ranges of blocks, too.
RANGE_BLOCKS = 1 << 17
#: Distinct words that one row of the word table lists.
WORDS_A_ROW = 5_000
SMOOTHING = 1000.0
EM_STEPS = 1
#: Taken off every training word's count, for the pieces to share.
DISCOUNT = 0.75
#: Expected counts are summed as whole numbers of this fraction, so that their order does not matter.
FRACTION = 1 << 16
SLICES = 16
WORD_MARK = "▁"
LOG10 = math.log(10)


def vocabulary(path: str | None = None) -> tuple[list[tuple[bool, bytes]], np.ndarray]:
    """The arcs of the lattice, (begins a word, bytes), and their weights, which sum to one.

    Of the file's pieces those that lower-cased words can hold; byte pieces add to arcs of one byte.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    weights: dict[tuple[bool, bytes], float] = {}
    ranked = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked.sort(key=lambda i: (-model.get_score(i), i))
    for rank, i in enumerate(ranked):
        piece = model.id_to_piece(i)
        begins, body = piece.startswith(WORD_MARK), piece.removeprefix(WORD_MARK)
        data = body.encode()
        if WORD_MARK in body or data != data.lower() or not (data or begins):
            continue
        weights[begins, data] = weights.get((begins, data), 0.0) + 1 / (rank + 3)
    for b in range(256):
        weights[False, bytes([b])] = weights.get((False, bytes([b])), 0.0) + 1 / (len(ranked) + 3)
    weights[True, b""] = weights.get((True, b""), 0.0) + 1 / (len(ranked) + 3)
    arcs = sorted(weights)
    found = np.array([weights[a] for a in arcs])
    return arcs, found / found.sum()


class Lattice:
    """All segmentations of words over weighted arcs."""

    def __init__(self, arcs: list[tuple[bool, bytes]], weights: np.ndarray):
        self.logs = np.log(weights).tolist()
        self.tries: tuple[dict, dict] = ({}, {})  # by: goes on, begins; key -1 holds the arc
        for i, (begins, data) in enumerate(arcs):
            node = self.tries[begins]
            for b in data:
                node = node.setdefault(b, {})
            node[-1] = i

    def edges(self, word: bytes) -> list[list[tuple[int, int]]]:
        """For each place, the arcs that start there: (where it ends, arc). The first list is of arcs that begin words."""
        out, n = [], len(word)
        for at in range(-1, n):
            node, found, to = self.tries[at < 0], [], max(at, 0)
            if at < 0 and -1 in node:
                found.append((0, node[-1]))
            while to < n and (node := node.get(word[to])) is not None:
                to += 1
                if -1 in node:
                    found.append((to, node[-1]))
            out.append(found)
        return out

    def forward(self, word: bytes, edges: list | None = None) -> list[float]:
        """Log probabilities of all ways to each place of word; the last one is the word's marginal."""
        edges, logs, exp, log = edges or self.edges(word), self.logs, math.exp, math.log
        ways: list[list[float]] = [[] for _ in range(len(word) + 1)]
        for to, arc in edges[0]:
            ways[to].append(logs[arc])
        alpha = []
        for at in range(len(word) + 1):
            w = ways[at]
            if len(w) > 1:
                most = max(w)
                a = most + log(sum([exp(x - most) for x in w]))
            else:
                a = w[0] if w else -math.inf
            alpha.append(a)
            if at < len(word) and a > -math.inf:
                for to, arc in edges[at + 1]:
                    ways[to].append(a + logs[arc])
        return alpha

    def expect(self, word: bytes, times: int, counts: list[float]) -> None:
        """Add times the expected number of each arc in word."""
        edges, logs, exp, log = self.edges(word), self.logs, math.exp, math.log
        alpha, n = self.forward(word, edges), len(word)
        beta = [-math.inf] * n + [0.0]
        for at in range(n - 1, -1, -1):
            w = [logs[arc] + beta[to] for to, arc in edges[at + 1]]
            most = max(w)
            beta[at] = most + log(sum([exp(x - most) for x in w]))
        whole = alpha[n]
        for to, arc in edges[0]:
            counts[arc] += times * exp(logs[arc] + beta[to] - whole)
        for at in range(n):
            base = alpha[at] - whole
            if base > -math.inf:
                for to, arc in edges[at + 1]:
                    counts[arc] += times * exp(base + logs[arc] + beta[to])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def held_out(key):
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.tobytes(), 1)


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def packed_words(words: list[bytes]) -> bytes:
    """Words hold no white space, so line feeds part them."""
    return zlib.compress(b"\n".join(words), 1)


def unpacked_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b"\n")


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. kind 1: a document's words as numbers in its block; kind 0: a block's distinct words, and how often training documents hold each."""
    key_kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        trained: list[np.ndarray] = []
        size, key_type = 0, pa.int64()

        def documents(block: int, keys: list, held: list, ids: list) -> pa.RecordBatch:
            m = len(keys)
            columns = [pa.array([1] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.array(keys, key_type), pa.array(held, pa.bool_())]
            columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([packed(x) for x in ids], pa.binary()), pa.nulls(m, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        def words(block: int) -> pa.RecordBatch:
            times = np.bincount(np.concatenate(trained), minlength=len(number)) if trained else np.zeros(len(number), np.int64)
            columns = [pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, key_type), pa.nulls(1, pa.bool_())]
            columns += [pa.array([len(number)], pa.int64()), pa.array([packed_words(list(number))], pa.binary()), pa.array([packed(times)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            key_type, at = batch.column(0).type, 0
            while at < batch.num_rows:
                block, first, ids = part << 32 | n, at, []
                while at < batch.num_rows and (size < BLOCK_BYTES):
                    text = batch.column(2)[at].as_py()
                    ids.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32))
                    if not batch.column(1)[at].as_py():
                        trained.append(ids[-1])
                    size += len(text) + 1
                    at += 1
                yield documents(block, batch.column(0)[first:at].to_pylist(), batch.column(1)[first:at].to_pylist(), ids)
                if size >= BLOCK_BYTES:
                    if number:
                        yield words(block)
                    number, trained, size, n = {}, [], 0, n + 1
        if number:
            yield words(part << 32 | n)

    names = ["kind", "block", "doc_id", "held_out", "n_words", "ids", "times"]
    schema = f"kind int, block long, doc_id {key_kind}, held_out boolean, n_words long, ids binary, times binary"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), utf8().alias("text")).mapInArrow(cut, schema)


def corpus_words(cut: DataFrame, range_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct words, WORDS_A_ROW to a row: times in all training documents, and which blocks hold each under which number.

    The first table has each word once. In the second, which is the same where there are at
    most range_blocks blocks, a word has one entry list for each range of so many blocks, and in
    each its total: so a word that stands in every block is nowhere gathered in one task.
    ends are the places in blocks and nths where each word's entries end.
    """
    rows = cut.filter("kind = 0").select("block", "n_words", "ids", "times")
    n_words, n_blocks = rows.agg(F.sum("n_words"), F.count("*")).first()
    tasks, ranges = max(1, -(-(n_words or 0) // WORDS_A_TASK)), max(1, -(-n_blocks // (range_blocks or RANGE_BLOCKS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, times in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                words, times = unpacked_words(ids), unpacked(times)
                to = np.array([zlib.crc32(w) % tasks for w in words]) * ranges + zlib.crc32(block.to_bytes(8, "little")) % ranges
                order = np.lexsort((np.arange(len(words)), to))
                ends = np.flatnonzero(np.r_[to[order][1:] != to[order][:-1], True]) + 1
                own = np.split(order, ends[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(to[x[0]]) for x in own], pa.int32()), pa.array([block] * len(own), pa.int64()), pa.array([packed_words([words[i] for i in x]) for x in own], pa.binary()),
                    pa.array([packed(x.astype(np.int32)) for x in own], pa.binary()), pa.array([packed(times[x]) for x in own], pa.binary()),
                ], ["task", "block", "words", "nths", "times"])

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        columns: list[list[np.ndarray]] = [[], [], [], []]
        task = None
        for batch in batches:
            task = batch.column(0)[0].as_py() if batch.num_rows else task
            for block, words, nths, times in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                own = np.array([number.setdefault(w, len(number)) for w in unpacked_words(words)], np.int64)
                for c, x in zip(columns, (own, np.full(len(own), block), unpacked(nths, np.int32), unpacked(times)), strict=True):
                    c.append(x)
        if not number:
            return
        own, block, nth, times = map(np.concatenate, columns)
        order = np.lexsort((nth, block, own))
        ends = np.searchsorted(own[order], np.arange(1, len(number) + 1), "left")
        total = np.bincount(own, weights=times, minlength=len(number)).astype(np.int64)
        block, nth, names = block[order], nth[order], list(number)
        for at in range(0, len(names), WORDS_A_ROW):
            to = min(at + WORDS_A_ROW, len(names))
            a, b = ends[at - 1] if at else 0, ends[to - 1]
            known = total[at:to]
            numbers = [pa.array([int(x)], pa.int64()) for x in (known.sum(), (known > 0).sum())]
            lists = [packed_words(names[at:to]), packed(known), packed(ends[at:to] - a), packed(block[a:b]), packed(nth[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *numbers, *(pa.array([x], pa.binary()) for x in lists)], ["task", "trained", "distinct", "words", "times", "ends", "blocks", "nths"])

    dealt = rows.mapInArrow(deal, "task int, block long, words binary, nths binary, times binary").repartitionById(tasks * ranges, F.col("task"))
    brought = materialise(dealt.mapInArrow(bring, "task int, trained long, distinct long, words binary, times binary, ends binary, blocks binary, nths binary"), "words")
    return (brought, brought) if ranges == 1 else _over_ranges(brought, tasks, ranges)


def _over_ranges(brought: DataFrame, tasks: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """corpus_words() from what each range of blocks holds: words with their totals, and the ranges' rows with those totals."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        task = None
        for batch in batches:
            for task, words, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w, n in zip(unpacked_words(words), unpacked(times).tolist(), strict=True):
                    sums[w] = sums.get(w, 0) + n
        names, known = list(sums), np.array(list(sums.values()), np.int64)
        for at in range(0, len(names), WORDS_A_ROW):
            own = known[at : at + WORDS_A_ROW]
            numbers = [pa.array([int(x)], pa.int64()) for x in (own.sum(), (own > 0).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *numbers, pa.array([packed_words(names[at : at + WORDS_A_ROW])], pa.binary()), pa.array([packed(own)], pa.binary())], ["task", "trained", "distinct", "words", "times"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for words, times, ends, blocks_, nths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ends is None:
                    sums.update(zip(unpacked_words(words), unpacked(times).tolist(), strict=True))
                else:
                    rows.append((words, packed(np.array([sums[w] for w in unpacked_words(words)], np.int64)), ends, blocks_, nths))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["words", "times", "ends", "blocks", "nths"])

    of_word = brought.select(F.floor(F.col("task") / ranges).cast("int").alias("task"), "words", "times")
    totals = materialise(of_word.repartitionById(tasks, F.col("task")).mapInArrow(total, "task int, trained long, distinct long, words binary, times binary"), "totals")
    each = F.explode(F.sequence(F.col("task") * ranges, F.col("task") * ranges + F.lit(ranges - 1)))
    none = F.lit(None).cast("binary")
    given = totals.select(each.alias("task"), "words", "times", none.alias("ends"), none.alias("blocks"), none.alias("nths"))
    both = given.unionByName(brought.select("task", "words", "times", "ends", "blocks", "nths")).repartitionById(tasks * ranges, F.col("task"))
    in_turn = both.sortWithinPartitions(F.col("ends").isNotNull()).select("words", "times", "ends", "blocks", "nths")
    return totals, materialise(in_turn.mapInArrow(fill, "words binary, times binary, ends binary, blocks binary, nths binary"), "places")


def expected_counts(words: DataFrame, arcs: list, weights: np.ndarray) -> np.ndarray:
    """Each arc's expected number in all training words; tasks sum their own and hand on slices."""
    width = -(-len(arcs) // SLICES)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(arcs, weights), [0.0] * len(arcs)
        for batch in batches:
            for listed, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, times in zip(unpacked_words(listed), unpacked(known).tolist(), strict=True):
                    if times:
                        lattice.expect(word, times, counts)
        found = np.zeros(width * SLICES, np.int64)
        found[: len(arcs)] = np.round(np.array(counts) * FRACTION)
        if found.any():
            parts = [x.tobytes() for x in found.reshape(SLICES, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(width, np.int64))[:] += np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros((SLICES, width), np.int64)
    slices = words.filter("distinct > 0").select("words", "times").mapInArrow(expect, "slice int, counts binary")
    for row in slices.repartitionById(SLICES, F.col("slice")).mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out.ravel()[: len(arcs)] / FRACTION


def learnt(words: DataFrame, path: str | None = None, steps: int = EM_STEPS) -> tuple[list, np.ndarray]:
    """The vocabulary's arcs with weights fitted to the training words."""
    arcs, weights = vocabulary(path)
    for _ in range(steps):
        counts = expected_counts(words, arcs, weights) + SMOOTHING * weights
        weights = counts / counts.sum()
    return arcs, weights


def marginals(words: DataFrame, arcs: list, weights: np.ndarray) -> DataFrame:
    """For every block and task a row: numbers of words in the block (as steps), their corpus counts, their log10 marginals (single precision)."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, parts = Lattice(arcs, weights), []
        for batch in batches:
            for listed, times, ends, block, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                logs = np.array([lattice.forward(w)[-1] for w in unpacked_words(listed)]) / LOG10
                sizes = np.diff(np.r_[0, unpacked(ends)])
                parts.append((unpacked(block), unpacked(nth, np.int32), np.repeat(unpacked(times), sizes), np.repeat(logs.astype(np.float32), sizes)))
        if not parts:
            return
        block, nth, times, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((nth, block))
        ids, first = np.unique(block[order], return_index=True)
        for b, own in zip(ids, np.split(order, first[1:]), strict=True):
            lists = (packed(np.diff(nth[own], prepend=np.int32(0))), packed(times[own]), logs[own].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), *(pa.array([x], pa.binary()) for x in lists)], ["block", "nths", "counts", "logs"])

    return words.select("words", "times", "ends", "blocks", "nths").mapInArrow(sum_up, "block long, nths binary, counts binary, logs binary")


def summed(cut: DataFrame, values: DataFrame, corpus: tuple[int, int], end: tuple[int, float]) -> DataFrame:
    """Every document's known tokens, base score, lattice score and mixed score.

    corpus: training words and distinct ones; end: how often training texts end and the
    log10 probability of the end token; words share what it leaves.
    """
    all_words, distinct_words = corpus
    end_count, end_log = end
    tokens, distinct = all_words + end_count, distinct_words + int(end_count > 0)
    word_log = math.log10(1 - 10**end_log)
    key_kind = cut.schema["doc_id"].dataType.simpleString()

    def base(count):
        return np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def whole(count, logs):
        if not all_words:
            return logs
        with np.errstate(divide="ignore"):
            own = np.log10(np.maximum(count - DISCOUNT, 0) / all_words)
        rest = logs + math.log10(DISCOUNT * distinct_words / all_words)
        return np.logaddexp(own * LOG10, rest * LOG10) / LOG10

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tables = None, ()
        waiting: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            rows = []
            for b, kind, nths, counts, logs, doc_id, held, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, waiting, tables = b, [], ()
                if kind == 0:
                    waiting.append((nths, counts, logs))
                    continue
                if not tables:
                    found = [(np.cumsum(unpacked(a, np.int32)), unpacked(b_), np.frombuffer(c, np.float32)) for a, b_, c in waiting]
                    times, logs_ = np.zeros(sum(len(x[0]) for x in found), np.int64), np.zeros(sum(len(x[0]) for x in found))
                    for nth, count, log in found:
                        times[nth], logs_[nth] = count, log
                    tables, waiting = (times > 0, base(times), logs_ + word_log, whole(times, logs_) + word_log), []
                own = unpacked(ids, np.int32)
                known, bases, scores, mixed = (t[own] for t in tables)
                rows.append((doc_id, held, n + 1, int(known.sum()) + int(end_count > 0), float(bases.sum() + base(end_count)), float(scores.sum() + end_log), float(mixed.sum() + end_log)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [batch.column(5).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "mixed_score"])

    none = F.lit(None)
    left = values.select("block", F.lit(0).alias("kind"), "nths", "counts", "logs", none.cast(key_kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("long").alias("n_words"), none.cast("binary").alias("ids"))
    right = cut.filter("kind = 1").select("block", "kind", none.cast("binary").alias("nths"), none.cast("binary").alias("counts"), none.cast("binary").alias("logs"), "doc_id", "held_out", "n_words", "ids")
    # block p << 32 | n is the n-th of partition p: one task for each
    last = cut.agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND(0xFFFFFFFF))).first()
    parts, each = (1, 1) if last[0] is None else (int(last[0]) + 1, int(last[1]) + 1)
    task = (F.shiftright("block", 32) * each + F.col("block").bitwiseAND(0xFFFFFFFF)).cast("int")
    both = left.union(right).repartitionById(parts * each, task).sortWithinPartitions("block", "kind")
    return both.mapInArrow(add, f"doc_id {key_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, mixed_score double")


def score_documents(docs: DataFrame, path: str | None = None, range_blocks: int | None = None) -> DataFrame:
    cut = materialise(blocks(docs), "blocks")
    words, places = corpus_words(cut, range_blocks)
    ends = cut.filter("kind = 1 AND NOT held_out").count()
    times, distinct = (x or 0 for x in words.agg(F.sum("trained"), F.sum("distinct")).first())
    arcs, weights = learnt(words, path)
    end = (ends, math.log10((ends + 0.5) / (times + ends + 1)))
    out = summed(cut, materialise(marginals(places, arcs, weights), "marginals"), (times, distinct), end)
    return out.withColumn("train_tokens", F.lit(times + ends).cast("long"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")
