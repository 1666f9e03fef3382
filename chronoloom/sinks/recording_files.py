"""A data source that writes one named file per recording, all in one job and all at once.

Rows are (file, part): a file's name below the folder, and its text in pieces, in order. A
file's rows come to one task one after the other; rows of many files may come to the same
task. A task writes hidden siblings; when all tasks are done the driver renames them, and
removes what other attempts of the same job have left. A job that fails removes all of
them, so that a reader sees the file of before or the whole new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, part string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a path or a URI."""
    found, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, inside.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """(hidden, final) paths of the files that a task has written."""

    files: list[tuple[str, str]]


class RecordingWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = located(self.path)
        done, stream, file = [], None, None
        try:
            for name, part in iterator:
                if name != file:
                    if stream is not None:
                        stream.close()
                    folder, _, last = f"{root}/{name}".rpartition("/")
                    files.create_dir(folder, recursive=True)
                    done.append((f"{folder}/.{last}.{self.job}.{uuid.uuid4().hex}", f"{folder}/{last}"))
                    stream, file = files.open_output_stream(done[-1][0]), name
                stream.write((part or "").encode())
        except BaseException:
            if stream is not None:
                stream.close()
            self._remove([hidden for hidden, _ in done])
            raise
        if stream is not None:
            stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = located(self.path)
        pairs = [p for m in messages if m is not None for p in m.files]
        if len({final for _, final in pairs}) < len(pairs):
            self.abort(messages)
            raise ValueError("a file's rows came to several tasks")
        for hidden, final in pairs:
            files.move(hidden, final)
        self._remove(self._left())

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(self._left())

    def _left(self) -> list[str]:
        """Hidden files of this job, also those of attempts that were killed."""
        files, root = located(self.path)
        if files.get_file_info(root).type == fs.FileType.NotFound:
            return []
        return [x.path for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if f".{self.job}." in x.base_name]

    def _remove(self, paths: list[str]) -> None:
        files, _ = located(self.path)
        for path in paths:
            if files.get_file_info(path).type != fs.FileType.NotFound:
                files.delete_file(path)


class RecordingFiles(DataSource):
    """``df.write.format("recording_files").mode("append").save(folder)``; the folder is one that all tasks and the driver share."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingFiles)


def save(parts: DataFrame, folder: str, *order: str) -> None:
    """Write parts (file, part and the columns of order), each file's in that order, to folder/<file>."""
    register(parts.sparkSession)
    dealt = parts.repartition("file").sortWithinPartitions("file", *order)
    dealt.select("file", "part").write.format("recording_files").mode("append").save(folder)
