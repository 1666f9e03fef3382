"""Matrices in array files (NPY, also as a member of an uncompressed NPZ), read by ranges of rows in many tasks."""

from __future__ import annotations

import ast
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoloom.sinks.recording_files import located

# Fixed value: how an array file begins.
MAGIC = b"\x93NUMPY"
#: Bytes of the rows that a task reads at once.
RANGE_BYTES = 16 << 20


class Matrix(NamedTuple):
    """Where a file's rows lie, and what they are."""

    begin: int
    rows: int
    columns: int
    kind: str


def array_header(file: BinaryIO, at: int) -> Matrix:
    """The matrix that begins at a place of a file; ValueError where there is none that can be read by rows."""
    file.seek(at)
    begin = file.read(8)
    if len(begin) < 8 or not begin.startswith(MAGIC) or begin[6] not in (1, 2, 3):
        raise ValueError("no array file")
    size = 2 if begin[6] == 1 else 4
    (length,) = struct.unpack("<H" if size == 2 else "<I", file.read(size).ljust(size, b"\0"))
    try:
        told = ast.literal_eval(file.read(length).decode("latin-1").strip())
        kind, shape, by_column = told["descr"], told["shape"], told["fortran_order"]
    except (ValueError, SyntaxError, KeyError, TypeError):
        raise ValueError("an array's header is broken") from None
    if kind not in ("<f4", "<f8") or not isinstance(shape, tuple) or len(shape) != 2 or by_column:
        raise ValueError(f"an array of {kind} and shape {shape} is no matrix of vectors")
    return Matrix(at + 8 + size + length, *shape, kind)


def member(file: BinaryIO, name: str) -> int:
    """Where a stored member of an archive begins."""
    try:
        with zipfile.ZipFile(file) as archive:
            found = archive.getinfo(f"{name}.npy")
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError(f"no array {name} in the archive: {e}") from None
    if found.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"array {name} is compressed")
    file.seek(found.header_offset + 26)
    names, extra = struct.unpack("<HH", file.read(4))
    return found.header_offset + 30 + names + extra


def matrix(path: str, name: str | None = None) -> Matrix:
    """The layout of an array file, or of a member of an archive."""
    files, inside = located(path)
    with files.open_input_file(inside) as file:
        found = array_header(file, member(file, name) if name else 0)
        if found.begin + found.rows * found.columns * int(found.kind[2:]) > file.size():
            raise ValueError("rows are missing")
        return found


def read_vectors(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, int]:
    """(nth, embedding) of a matrix's rows, from 0, and their number; each task reads its ranges of the file."""
    found = matrix(path, name)
    width = found.columns * int(found.kind[2:])
    each = max(1, RANGE_BYTES // max(1, width))
    ranges = -(-found.rows // each)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inside = located(path)
        with files.open_input_file(inside) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    first, last = k * each, min((k + 1) * each, found.rows)
                    file.seek(found.begin + first * width)
                    values = np.frombuffer(file.read((last - first) * width), found.kind).astype(np.float32)
                    vectors = pa.ListArray.from_arrays(np.arange(last - first + 1, dtype=np.int32) * found.columns, pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), vectors], ["nth", "embedding"])

    return spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInArrow(read, "nth long, embedding array<float>"), found.rows
