"""Small files written at once or not at all, here or in a shared store."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def write_atomic(path: str | Path, data: bytes | str | Iterable[str]) -> None:
    """Replace path by data, whole or in parts, through a synced sibling; nothing stays behind after a failure."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            for part in [data] if isinstance(data, bytes | str) else data:
                f.write(part.encode() if isinstance(part, str) else part)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.path = str(path).rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._at("").getFileSystem(self.conf)
        # beside files of the local system no checksum files are kept: contents have digests of their own
        self.bare = self.files.getRawFileSystem() if hasattr(self.files, "getRawFileSystem") and self.files.getScheme() == "file" else self.files

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.files.exists(self._at("")):
            return []
        return sorted(x.getPath().getName() for x in self.bare.listStatus(self._at("")))

    def read(self, name: str) -> str:
        """A small file's text; ValueError where it cannot be read."""
        try:
            stream = self.bare.open(self._at(name))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        except (Py4JJavaError, UnicodeDecodeError) as e:
            raise ValueError(f"{name} cannot be read: {e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e}") from None

    def replace(self, name: str, text: str) -> None:
        """Replace a file by text through a synced sibling and one rename; nothing stays behind after a failure."""
        sibling = f".{name}.{uuid.uuid4().hex}"
        try:
            stream = self.bare.create(self._at(sibling), False)
            try:
                stream.write(bytearray(text.encode()))
                stream.hsync()
            finally:
                stream.close()
            self._rename(sibling, name)
        except BaseException:
            self.delete(sibling)
            raise

    def _rename(self, old: str, new: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        context.rename(self.files.makeQualified(self._at(old)), self.files.makeQualified(self._at(new)), how)

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)
