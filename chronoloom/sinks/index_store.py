"""A vector index in generations: data is written beside the old, then one file's replacement commits it.

The data of a generation is Parquet written by Spark; the manifest names the generation,
the embedding model, dimension, row count and the SHA-256 of every data file. A reader
sees the old generation or the new one, whole. The folder may lie in any file system that
Spark reaches: files are hashed in tasks, and only names, sizes and digests come to the
driver.
"""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.vectors import l2_normalize, top_k
from chronoloom.operators.stretches import STRETCH_IDS, numbered
from chronoloom.sinks.files import Folder
from chronoloom.sources.arrays import read_vectors
from chronoloom.sources.worklogs import read_lines

MANIFEST = "manifest.json"
GENERATION = re.compile(r"gen-[0-9a-f]{32}")
# The files and the documents' fields of indexes without generations.
OLD_FILES = {"vectors": "vectors.npz", "documents": "documents.jsonl"}
DOCUMENT = "doc_id string, text string, source string, t string, t_end string, duration_seconds double, app_guess string, action string"
#: Vectors in a data file at most, so that one task can hash it.
ROWS_A_FILE = 200_000


def build(documents: DataFrame) -> DataFrame:
    """documents (doc_id, embedding, ...) with unit vectors, as floats."""
    return documents.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))


def digests(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Size and SHA-256 of the Parquet files in a folder, by name; hashed in tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    rows = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", F.sha2("content", 256).alias("digest")).collect()
    return {r["name"]: {"sha256": r["digest"], "size": r["length"]} for r in sorted(rows)}


def names(spark: SparkSession, directory: str | Path) -> list[str]:
    """What lies in an index's folder."""
    return Folder(spark, directory).names()


def save(index: DataFrame, directory: str | Path, model: str) -> str:
    """Write a generation and commit it; older ones are removed after the commit, a failed one at once."""
    spark = index.sparkSession
    folder, name = Folder(spark, directory), f"gen-{uuid.uuid4().hex}"
    target = f"{folder.path}/{name}"
    try:
        index.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(target)
        stored = spark.read.schema(index.schema).parquet(target)
        facts = stored.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
        if facts["d"] != facts["least"]:
            raise ValueError("vectors of several dimensions")
        manifest = {"model": model, "generation": name, "count": facts["n"], "dimension": facts["d"] or 0, "files": digests(spark, target)}
        folder.replace(MANIFEST, json.dumps(manifest, ensure_ascii=False))
    except BaseException:
        folder.delete(name)
        raise
    for old in folder.names():
        if (GENERATION.fullmatch(old) and old != name) or old in OLD_FILES.values():
            folder.delete(old)
    return name


def load(spark: SparkSession, directory: str | Path, model: str | None = None) -> DataFrame:
    """The committed generation; ValueError where it is of another model, incomplete, altered or points elsewhere."""
    folder = Folder(spark, directory)
    if MANIFEST not in folder.names():
        raise FileNotFoundError(f"no index in {directory}")
    manifest = json.loads(folder.read(MANIFEST))
    if isinstance(manifest, dict) and "model" in manifest and not manifest.keys() & {"generation", "files"}:
        _of_model(manifest, model)
        return _without_generations(spark, folder)
    if not isinstance(manifest, dict) or not manifest.keys() >= {"model", "generation", "count", "files"}:
        raise ValueError("the manifest is incomplete")
    name = str(manifest["generation"])
    if not GENERATION.fullmatch(name):
        raise ValueError(f"generation {name!r} leads out of the index")
    _of_model(manifest, model)
    found = digests(spark, f"{folder.path}/{name}") if name in folder.names() else {}
    for file, facts in manifest["files"].items():
        if file not in found:
            raise ValueError(f"data file {file} is missing")
        if found[file] != facts:
            raise ValueError(f"data file {file} was altered")
    out = spark.read.parquet(f"{folder.path}/{name}")
    if out.count() != manifest["count"]:
        raise ValueError("row count differs from the manifest's")
    return out


def _of_model(manifest: dict, model: str | None) -> None:
    if model is not None and manifest["model"] != model:
        raise ValueError(f"the index is of model {manifest['model']}, not {model}")


def _without_generations(spark: SparkSession, folder: Folder) -> DataFrame:
    """An index of the layout before generations: vectors in an array file, documents as lines beside it, in the same order.

    Neither side has a key: the n-th row belongs to the n-th line that is not blank, so both
    are numbered, by ranges of the file and by its splits, and joined by number.
    """
    for name in OLD_FILES.values():
        if name not in folder.names():
            raise ValueError(f"data file {name} is missing")
    vectors, rows = read_vectors(spark, f"{folder.path}/{OLD_FILES['vectors']}", "vectors")
    lines, splits = read_lines(spark, f"{folder.path}/{OLD_FILES['documents']}")
    if not splits.filter("bad IS NOT NULL").isEmpty():
        raise ValueError("a document's line is malformed")
    documents = numbered(lines.filter(F.trim("value") != ""), "nth", "file", ["line"], STRETCH_IDS)
    held = documents.count()
    if held != rows:
        raise ValueError(f"{rows} vectors, but {held} documents")
    parsed = documents.select("nth", F.from_json("value", DOCUMENT).alias("d")).select("nth", "d.*")
    return parsed.join(vectors, "nth").drop("nth")


def search(index: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k documents nearest to a query vector: rank, score and the documents' columns."""
    asked = index.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
    return top_k(index, asked, k, "doc_id").join(index.drop("embedding"), "doc_id").drop("query_id").orderBy("rank")
