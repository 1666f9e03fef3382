"""Harmonic packing of token sequences.

A piece of n tokens belongs to reciprocal class k = capacity // n: it fits a k-th of a
sequence, and a bin of class k takes exactly k pieces. Bins are filled class by class,
with nothing to search for and nothing shared, so each worker packs its own documents.

Documents may be cut, which makes the classes tight: whole sequences come off first, then
halves, quarters, ... of the capacity while the rest holds them (down to 128 tokens, class
16). These fill their bins without padding; only rests below 128 tokens pad a little.
Bins still open when a worker has read all its documents are emptied, and their pieces
are laid end to end, cut where a sequence is full. What remains at the very end is cut
into powers of two, which need no padding either: at most eleven short sequences a worker.

Edge cases: null and empty texts are the closing token alone; repeated rows are packed
each; ids of rows may be null; a very long text is tokenized word by word; empty tables
give empty results. Sequence ids are the partition's number times 2^33 plus a count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.alignment import byte_symbols
from chronoloom.llm.common import table, thrifty, utf8, worker_cache

CAPACITY = 2048
LEAST_CUT = 128
CLOSING = 1
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers at most; beyond it, it starts afresh.
REMEMBERED = 500_000
#: Strings of special tokens, which the tokenizer looks for before it lower-cases and splits.
UNSPLITTABLE = re.compile(rb"<\|(?:start|end)oftext\|>", re.IGNORECASE)
#: Small letters, ASCII or from U+00DF to U+00FF, which the tokenizer's normalizer leaves alone and its splits keep together; those with ASCII signs after them.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
SIGNED = r"\A(?P<letters>[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[!-/:-@\[-`{-~]*)\z"
#: Bytes of the longest word that a worker remembers.
LONG_WORD = 100
BATCH_IDS = 1 << 20


def word_tokenizer(path: str | None = None):
    """The tokenizer of a file, kept by the worker."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or public_tokenizers.path(VOCABULARY)
    cache = worker_cache("packing")
    if ("tokenizer", path) not in cache:
        cache["tokenizer", path] = Tokenizer.from_file(path)
    return cache["tokenizer", path]


def word_ids(words: list[bytes], tokenizer, ends: np.ndarray) -> list[bytes]:
    """Little-endian ids of distinct words; ends: which ids close a run of letters or of other signs.

    Words of letters alone are encoded many at a time, as one text: each closes with the
    only such id it has.
    """
    texts = [w.decode("utf-8", "replace") for w in words]
    out: list[bytes | None] = [None] * len(words)
    plain = [i for i, t in enumerate(texts) if t.isalpha()]
    for at in range(0, len(plain), 5000):
        part = plain[at : at + 5000]
        ids = np.array(tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, "<u4")
        closes = np.flatnonzero(ends[ids]) + 1
        if len(closes) == len(part):
            data, begin = ids.tobytes(), 0
            for i, end in zip(part, (4 * closes).tolist(), strict=True):
                out[i] = data[begin:end]
                begin = end
    rest = [i for i, ids in enumerate(out) if ids is None]
    for at in range(0, len(rest), 20_000):
        part = rest[at : at + 20_000]
        coded = tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)
        for i, c in zip(part, coded, strict=True):
            out[i] = np.array(c.ids, "<u4").tobytes()
    return out


def learn(stems: list[bytes], tokenizer) -> list[bytes]:
    """The ids of distinct words: the model itself codes letters that the tokenizer would not change or part, the tokenizer others."""
    out: list[bytes | None] = [None] * len(stems)
    code, spell = tokenizer.model.tokenize, {b: c for c, b in byte_symbols().items()}
    plain, ids, ends = [i for i, w in enumerate(stems) if LETTERS.fullmatch(w)], [], [0]
    for i in plain:
        word = stems[i]
        ids += [t.id for t in code(word.decode() if word.isascii() else word.decode("latin-1").translate(spell))]
        ends.append(4 * len(ids))
    data = np.array(ids, "<u4").tobytes()
    for i, begin, end in zip(plain, ends, ends[1:], strict=False):
        out[i] = data[begin:end]
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(rest, word_ids([stems[i] for i in rest], tokenizer, token_ends(tokenizer)), strict=True):
        out[i] = ids
    return out


def recall(words: list[bytes], tokenizer, known: dict[bytes, bytes]) -> list[bytes]:
    """The ids of distinct words, from what the worker knows and, from now on, of those it did not know.

    Where that becomes too much, it goes on with these words alone. Very long words are
    coded each time: they seldom come again and would take much memory.
    """
    found = list(map(known.get, words))
    fresh = [i for i, ids in enumerate(found) if ids is None]
    for i, ids in zip(fresh, learn([words[i] for i in fresh], tokenizer), strict=True):
        found[i] = ids
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        fresh = range(len(words)) if len(words) <= REMEMBERED else []
    known.update((words[i], found[i]) for i in fresh if len(words[i]) <= LONG_WORD)
    return found


def ids_of(words: pa.Array, tokenizer, known: dict[bytes, bytes]) -> pa.Array:
    """The ids of distinct words; signs after plain letters are tokens of their own, so letters are coded once for all that follows."""
    parts = pc.extract_regex(words, SIGNED)
    stems = pc.coalesce(pc.struct_field(parts, "letters"), words).dictionary_encode()
    signs = pc.fill_null(pc.struct_field(parts, "signs"), "").dictionary_encode()
    both = [x.dictionary.view(pa.large_binary()).to_pylist() for x in (stems, signs)]
    coded = [pa.array(recall(x, tokenizer, known), pa.large_binary()) for x in both]
    return pc.binary_join_element_wise(coded[0].take(stems.indices), coded[1].take(signs.indices), pa.scalar(b"", pa.large_binary()))


def encode(texts: list[bytes], tokenizer, known: dict[bytes, bytes], closing: int = CLOSING) -> list[np.ndarray]:
    """The ids of whole texts, each with the closing token.

    The tokenizer drops white space and lets no token cross it, so a text's ids are its
    words' ids: Arrow numbers the distinct words of all texts, and lays their ids out where
    they stand. Texts with the strings of special tokens are encoded in one go.

    The tokenizer composes characters before it lower-cases, and some letters can only be
    composed when small. So texts with combining marks keep their capitals.
    """
    odd = [b"<|" in t and UNSPLITTABLE.search(t) is not None for t in texts]
    small = [b"" if o else t if b"\xcc" in t or b"\xcd" in t else t.lower() for t, o in zip(texts, odd, strict=True)]
    split = pc.ascii_split_whitespace(pa.array(small, pa.large_binary()).view(pa.large_string()))
    words = split.flatten().dictionary_encode()
    _, places, data = ids_of(words.dictionary, tokenizer, known).take(words.indices).buffers()
    ends = np.frombuffer(places, "<i8")[np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]].tolist()
    end, data, out = np.array([closing], "<u4").tobytes(), memoryview(data), []
    for text, o, a, b in zip(texts, odd, ends, ends[1:], strict=False):
        if o:
            own = np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        else:
            own = data[a:b]
        out.append(np.frombuffer(b"".join((own, end)), "<u4"))
    return out


def token_ends(tokenizer) -> np.ndarray:
    """Which ids end a word of the tokenizer's own splitting."""
    cache = worker_cache("packing")
    if "token ends" not in cache:
        vocabulary = tokenizer.get_vocab()
        cache["token ends"] = np.zeros(max(vocabulary.values()) + 1, bool)
        cache["token ends"][[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return cache["token ends"]


def cut(n: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[int]:
    """Lengths of the pieces of a document: capacity over powers of two, then the rest."""
    out, size = [], capacity
    while n and size >= least:
        take = n // size
        out += [size] * take
        n -= take * size
        size //= 2
    return [*out, n] if n else out


class Packer:
    """Harmonic bins of one worker; emit(sequence, offset, piece) is called once for every placed piece.

    A piece is (document, start, ids); bins hold at most one open sequence a class, so
    memory is bounded by the number of classes whatever the worker reads.
    """

    def __init__(self, emit, first: int = 0, capacity: int = CAPACITY):
        self.emit, self.sequence, self.capacity = emit, first, capacity
        self.open: dict[int, list] = {}

    def add(self, piece: tuple) -> None:
        kind = self.capacity // len(piece[2])
        bin_ = self.open.setdefault(kind, [])
        bin_.append(piece)
        if len(bin_) == kind:
            self.close(self.open.pop(kind))

    def close(self, pieces: list) -> None:
        offset = 0
        for p in pieces:
            self.emit(self.sequence, offset, p)
            offset += len(p[2])
        self.sequence += 1

    def finish(self) -> None:
        """Lay the pieces of open bins end to end, in sequences cut to size."""
        rest = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        room, held = 0, []
        for document, start, ids in rest:
            at = 0
            while at < len(ids):
                if not room:
                    if held:
                        self.close(held)
                    held, room = [], self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) - at)
                held.append((document, start + at, ids[at : at + take]))
                at, room, left = at + take, room - take, left - take
        if held:
            self.close(held)


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place in it, ids, and place in a sequence; ids_crc32 is of its little-endian ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = word_tokenizer(path), worker_cache("packing").setdefault("word ids", {})
        rows: list[tuple] = []
        held = 0

        def emit(sequence: int, offset: int, piece: tuple) -> None:
            nonlocal held
            (document, tokens), start, ids = piece
            data = ids.tobytes()
            rows.append((document, start, len(ids), zlib.crc32(data), tokens, sequence, offset, data if with_ids else None))
            held += len(ids)

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.binary())]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names)

        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        packer, key_type = Packer(emit, TaskContext.get().partitionId() << 33, capacity), None
        for batch in batches:
            key_type = batch.column(0).type
            sizes, keys = pc.binary_length(batch.column(1)).to_pylist(), batch.column(0).to_pylist()
            begin = 0
            while begin < len(sizes):  # some megabytes of text at once
                end, size = begin, 0
                while end < len(sizes) and (size < 2 << 20 or end == begin):
                    size += sizes[end]
                    end += 1
                texts = [t.as_py() for t in batch.column(1).slice(begin, end - begin)]
                for document, ids in zip(keys[begin:end], encode(texts, tokenizer, known), strict=True):
                    start = 0
                    for n in cut(len(ids), capacity):
                        packer.add(((document, len(ids)), start, ids[start : start + n].copy()))
                        start += n
                    if held >= BATCH_IDS:
                        yield batch_of()
                begin = end
        packer.finish()
        if key_type is not None:
            yield batch_of()

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(key, utf8().alias("__text")).mapInArrow(thrifty("packing", run), schema).withColumnRenamed("key", key)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: their ids in order, unpadded, and the length to pad to."""
    from pyspark.sql import functions as F

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    power = F.bit_count("length") == 1
    return out.select("sequence_id", "length", joined.alias("ids"), F.when(power, F.col("length")).otherwise(capacity).alias("padded_length"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
