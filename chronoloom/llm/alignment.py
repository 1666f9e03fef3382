"""Cross-tokenizer alignment.

A text's bytes get one label each: ``.`` none, ``a`` a token of A ends here, ``b`` one of B
does, ``c`` both do. A regular expression takes the spans up to each ``c``; the labels
counted in a span say how many tokens of either side make up its group. Every label but
``.`` ends one stretch that a single token of A shares with a single token of B: these
stretches are the links.

Both tokenizers cut between a word and the white space after it, so a text's labels are
its chunks' labels, and a worker aligns each distinct chunk (white space and the word after
it) once. Texts with white space beyond the ASCII kind are aligned in one go.

How many documents link a pair of ids is counted over all documents: tasks count what they
read, counts are summed. The pairs are bounded by the two vocabularies, not by the
documents. Up to PAIRS of them return to the documents by broadcast; beyond that, counts
meet the documents' pairs in a join whose hot pairs are split.

Edge cases: null and empty texts, and texts whose tokens do not spell them (a U+2581 of their
own, say), have no tokens: zeros and an empty digest. Repeated rows are documents of their
own; ids may be null; strings of special tokens are plain text; very long texts cost
linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import materialise, spread_join, table, utf8, worker_cache

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids that may be broadcast: 20 bytes each.
PAIRS = 1 << 21
#: Pairs that a task counts before it passes its counts on, and chunks that a worker remembers.
HELD, REMEMBERED = 1 << 21, 300_000
#: White space that the vocabularies' patterns know besides the ASCII kind; texts with it are aligned in one go.
RARE_SPACES = "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \t\n\x0b\x0c\r")
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: White space and the word after it. A carriage return joins what it parts, as B has pieces with one after other characters.
CHUNK = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+(?:\r[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+)*(?:\r[ \t\n\x0b\x0c\r]*\Z)?|[ \t\n\x0b\x0c\r]+")
#: White space that the faster library's pattern would recurse over too deeply.
LONG_SPACE = re.compile(r"\s{10000}")
#: What keeps a text from being words parted by single spaces and newlines.
UNEVEN = ("\t", "\x0b", "\x0c", "\r", "  ", "\n\n", " \n", "\n ")
GROUP = re.compile(rb"[^c]*c")
LABELS = bytes.maketrans(bytes(range(4)), b".abc")
SPACE_MARK = "▁"


class Aligned(NamedTuple):
    """What a text's or a chunk's alignment comes to: groups as text, the linked pairs in order, and tokens of A << 40 | tokens of B."""

    groups: bytes
    pairs: bytes
    tokens: int


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """One label a byte, for tokens that end before these places."""
    marks = np.zeros(max(ends_a[-1:].sum(), ends_b[-1:].sum()), np.uint8)
    marks[ends_a - 1] |= 1
    marks[ends_b - 1] |= 2
    return marks.tobytes().translate(LABELS)


def groups(marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each group ends in the text, in the tokens of A and in those of B, as the labels of its span count them."""
    ends = np.fromiter(map(re.Match.end, GROUP.finditer(marks)), np.int64)
    kinds = np.frombuffer(marks, np.uint8)
    both = kinds == ord("c")
    return ends, *(np.cumsum(both | (kinds == ord(x)))[ends - 1] for x in "ab")


def links(marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of tokens that share bytes: where their common stretch ends, and their places in A and in B."""
    kinds = np.frombuffer(marks, np.uint8)
    at = np.flatnonzero(kinds != ord("."))
    of_a, of_b = kinds[at] != ord("b"), kinds[at] != ord("a")
    return at, np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b


def chunks_of(text: str) -> list[str]:
    """The chunks of a space and the text; the space before a word is left out. Plain texts are split without a pattern."""
    if text.strip(" \n") == text and not any(x in text for x in UNEVEN):
        return text.replace("\n", " \n").split(" ")
    return [c[1:] if c[0] == " " and c[1:2].strip(ASCII_SPACE) else c for c in CHUNK.findall(f" {text}")]


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """The two tokenizers and their tokens as bytes; pair (a, b) has the code a * size of B + b."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import os

        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path_a = path_a or public_tokenizers.path(VOCABULARY_A)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path(VOCABULARY_B))
        symbols, vocabulary = byte_symbols(), self.a.get_vocab(with_added_tokens=False)
        special = self.a.get_added_tokens_decoder()
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(symbols[c] for c in token) if i not in special else b""
        self.ranked = ranked(path_a, self.bytes_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = np.array([str(i).ljust(len(str(size)) + 1) for i in range(size)], "S").view(np.uint8).reshape(size, -1)
        self.n_digits = np.array([len(str(i)) for i in range(size)])
        self.length_a, self.length_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        self.space = self.b.piece_to_id(SPACE_MARK)
        normal = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        #: Whether B, too, cuts before each white space of CHUNK that begins a chunk; otherwise whole texts are aligned.
        self.parts = not any(re.search(rf"[^{SPACE_MARK}]{SPACE_MARK}|(?s:.)[ \t\n\x0b\x0c]|[ \t\n\x0b\x0c](?s:.)", p) for p in normal)
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    @property
    def wide(self) -> type:
        return np.uint32 if len(self.bytes_a) * len(self.bytes_b) <= 1 << 32 else np.uint64

    def ids_a(self, text: str) -> list[int]:
        if self.ranked and not LONG_SPACE.search(text):
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with white space. B puts a space before a text: it stands for the text's own, or is a piece of its own before other white space."""
        coded = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [[self.space] if t == " " else ids if t[0] == " " else ids[1:] for t, ids in zip(texts, coded, strict=True)]

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """Of texts that begin with white space, each on its own; None where tokens do not spell the text."""
        return [(self._aligned([t], self.ids_a(t), b) or [None])[0] for t, b in zip(texts, self.ids_b(texts), strict=True)]

    def align_chunks(self, chunks: list[str]) -> list[Aligned | None]:
        """align() of chunks that end in a word: laid end to end, they are aligned at once."""
        found = self._aligned(chunks, self.ids_a("".join(chunks)), list(itertools.chain.from_iterable(self.ids_b(chunks))))
        return found or self.align(chunks)

    def _aligned(self, chunks: list[str], a: list[int], b: list[int]) -> list[Aligned] | None:
        """One alignment a chunk, of the tokens of all chunks end to end; None where the tokens do not spell them."""
        raw = [c.encode("utf-8") for c in chunks]
        data, spelt_a, spelt_b = b"".join(raw), self.bytes_a, self.bytes_b
        if b"".join([spelt_a[i] for i in a]) != data or b"".join([spelt_b[i] for i in b]) != data:
            return None
        ids_a, ids_b = np.array(a), np.array(b)
        marks = labels(np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b]))
        at, i, j = links(marks)
        pairs = (ids_a[i] * len(self.bytes_b) + ids_b[j]).astype(self.wide)
        ends, to_a, to_b = groups(marks)
        said, said_to = self._said(ids_a, ids_b, to_a, to_b)
        cuts = np.cumsum([len(r) for r in raw])
        last = np.searchsorted(ends, cuts)
        tokens = to_a[last] << 40 | to_b[last]
        out, from_text, from_pair, whole, size = [], 0, 0, pairs.tobytes(), pairs.itemsize
        for to_text, to_pair, n in zip(said_to[last].tolist(), (np.searchsorted(at, cuts) * size).tolist(), np.diff(tokens, prepend=0).tolist(), strict=True):
            out.append(Aligned(said[from_text : to_text - 1], whole[from_pair:to_pair], n))
            from_text, from_pair = to_text, to_pair
        return out

    def _said(self, ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, and where each ends in it, its semicolon included: of each group the ids of A, then those of B."""
        n_a, n_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        at_a = n_a + np.concatenate([[0], to_b])[np.searchsorted(to_a, n_a, "right")]
        at_b = n_b + to_a[np.searchsorted(to_b, n_b, "right")]
        ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        marks[at_a[to_a - 1]], marks[at_b[to_b - 1]] = ord("|"), ord(";")
        text, n = self.digits[ids], self.n_digits[ids]
        text[np.arange(len(ids)), n] = marks
        return text[np.arange(text.shape[1]) <= n[:, None]].tobytes(), np.cumsum(n + 1)[at_b[to_b - 1]]

    def learn(self, chunks: set[str]) -> None:
        """Have all these chunks in known; of what was known, what no text of late has shown is forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        missing = chunks - self.known.keys()
        self.known.update((c, self.older[c]) for c in missing & self.older.keys())
        fresh = [c for c in missing if c not in self.older]
        words = [c for c in fresh if c[-1] not in ASCII_SPACE]
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            self.known.update(zip(part, self.align_chunks([spaced(c) for c in part]), strict=True))
        rest = [c for c in fresh if c[-1] in ASCII_SPACE]
        self.known.update(zip(rest, self.align([spaced(c) for c in rest]), strict=True))

    def texts(self, texts: list[str]) -> Iterator[Aligned | None]:
        """Alignments of whole texts, each with a space before it; None for the empty text."""
        split: list[list[str] | None] = [None if not self.parts or not t or any(c in t for c in RARE_SPACES) else chunks_of(t) for t in texts]
        self.learn(set().union(*[chunks for chunks in split if chunks]))
        for text, chunks in zip(texts, split, strict=True):
            if not text:
                yield None
            elif chunks is None:
                yield self.align([f" {text}"])[0]
            else:
                found = [self.known[c] for c in chunks]
                if None in found:
                    yield None
                else:
                    said, pairs, tokens = zip(*found, strict=True)
                    yield Aligned(b";".join(said), b"".join(pairs), sum(tokens))


def spaced(chunk: str) -> str:
    return chunk if chunk[0] in ASCII_SPACE else f" {chunk}"


def ranked(path: str, spelt: list[bytes]):
    """The faster library's coder of a byte-level vocabulary whose ids are its merges' ranks; None for other vocabularies."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    model, before = stored["model"], stored["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    by_rank = all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges))
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and stored["normalizer"] is None
    if model["type"] != "BPE" or not by_rank or not plain or not all(spelt[: 256 + len(merges)]):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(spelt[: 256 + len(merges)])}, special_tokens={})


def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """The worker's own."""
    cache = worker_cache("alignment")
    if ("aligner", path_a, path_b) not in cache:
        cache["aligner", path_a, path_b] = Aligner(path_a, path_b)
    return cache["aligner", path_a, path_b]


def slices(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of a list that hold about limit bytes, or a single text."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (size < limit or end == begin):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def aligned(docs: DataFrame, key: str = "doc_id", with_groups: bool = False, paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the groups' digest, and the distinct pairs linked, with how often.

    row numbers the rows; codes and times are arrays of unsigned integers as bytes; groups
    is the text of the groups, if asked for.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
    names = [f.split()[0] for f in schema.split(", ")] + (["groups"] if with_groups else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = aligner(*paths), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, raw = batch.column(0), [t.as_py() for t in batch.column(1)]
            for begin, end in slices(raw):
                out = []
                for found in both.texts([t.decode("utf-8", "replace") for t in raw[begin:end]]):
                    if found is None:
                        out.append((row, 0, 0, 0, 0, "", b"", b"", b""))
                    else:
                        pairs = np.frombuffer(found.pairs, both.wide)
                        codes, times = np.unique(pairs, return_counts=True)
                        out.append((row, found.tokens >> 40, found.tokens & (1 << 40) - 1, found.groups.count(b"|"), len(pairs), hashlib.sha256(found.groups).hexdigest(), codes.tobytes(), times.astype(np.uint32).tobytes(), found.groups))
                    row += 1
                columns = list(zip(*out, strict=True))
                arrays = [keys.slice(begin, end - begin), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()), *(pa.array(c, pa.binary()) for c in columns[6:8])]
                if with_groups:
                    arrays.append(pa.array([g.decode() for g in columns[8]], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = docs.select(key, utf8().alias("__text")).mapInArrow(run, schema + (", groups string" if with_groups else ""))
    return out.withColumnRenamed("key", key)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes added up, in order of the codes."""
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def pair_counts(rows: DataFrame, paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(code, n, best): documents that link each pair, and whether no other pair of its id of A has more. rows as from aligned()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, held, size = aligner(*paths).wide, [], 0

        def batch_of() -> pa.RecordBatch:
            codes, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            codes, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), wide), return_counts=True)
            held.append((codes, n))
            size += len(codes)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if 2 * size > HELD:
                    yield batch_of()
                    held, size = [], 0
        if size:
            yield batch_of()

    width = len(Aligner(*paths).bytes_b)
    counts = rows.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("code") / width)))
    return counts.withColumn("best", F.col("n") == most)


def weighed(rows: DataFrame, counts: DataFrame, paths: tuple[str | None, str | None] = (None, None), pairs: int = PAIRS) -> DataFrame:
    """rows of aligned() with n_best and count_sum instead of codes and times; counts as from pair_counts()."""
    spark, found = rows.sparkSession, counts.count()
    kept = [c for c in rows.columns if c not in ("codes", "times")]
    if found > pairs:
        return _joined(rows, counts, kept, paths)
    table_ = counts.toArrow()
    codes = table_["code"].to_numpy()
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast((codes[order], table_["n"].to_numpy()[order], table_["best"].to_numpy(zero_copy_only=False)[order]))
    schema = rows.select(*kept).schema.add("n_best", "long").add("count_sum", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, (codes, n, best) = aligner(*paths).wide, shared.value
        for batch in batches:
            out = []
            for these, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                at, times = np.searchsorted(codes, np.frombuffer(these, wide).astype(np.int64)), np.frombuffer(times, np.uint32).astype(np.int64)
                out.append((int(times[best[at]].sum()), int((n[at] * times).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], [*kept, "n_best", "count_sum"])

    return rows.mapInArrow(weigh, schema)


def _joined(rows: DataFrame, counts: DataFrame, kept: list[str], paths: tuple[str | None, str | None]) -> DataFrame:
    """weighed() for any number of pairs: one short row per document and pair meets the counts."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = aligner(*paths).wide
        for batch in batches:
            for row, these, times in zip(*(batch.column(c).to_pylist() for c in ("row", "codes", "times")), strict=True):
                codes = np.frombuffer(these, wide).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row)), pa.array(codes), pa.array(np.frombuffer(times, np.uint32).astype(np.int64))], ["row", "code", "times"])

    linked = rows.select("row", "codes", "times").filter(F.octet_length("codes") > 0).mapInArrow(flat, "row long, code long, times long")
    met = spread_join(linked, counts.withColumn("__n", F.col("n")), "code", F.xxhash64("row"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.select(*kept).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def op12_alignment(spark: SparkSession, sf_dir: str, pairs: int = PAIRS) -> DataFrame:
    """Groups, links and corpus-wide pair counts of every document."""
    rows = materialise(aligned(table(spark, sf_dir, "documents")), "aligned", "zstd")
    counts = materialise(pair_counts(rows), "pair-counts")
    return weighed(rows, counts, pairs=pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
