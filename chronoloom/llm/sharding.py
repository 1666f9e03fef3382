"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands, a parameter that never
changes for a data set), bytes are summed per slot, and a versioned map says which
shard holds which slot. Rebalancing edits the map only: it moves whole slots and
raises the version, so records never rehash. The map has one row per slot, so the
driver holds ``slots`` entries whatever the data's size.

The map is stored, one folder a version, and read back; a run edits the last version
and stores the next one only if shards have drifted apart.

Law ``bytes`` holds down to the size of single slots: one id whose rows or text outweigh a
shard is one slot and stays whole; the other shards share the rest nearly equally. Equal texts are not kept together, as a large group of
copies would break the law.

Edge cases: null texts have no bytes (size 8); null ids hash by their text; repeated
rows are rows of their own; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import materialise, scratch_path, table

SLOTS = 4096
SHARDS = 24
RECORD_OVERHEAD = 8
#: How far from the mean a shard's bytes may lie before slots are moved.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """owner[slot] is the shard that holds it."""

    version: int
    shards: int
    owner: tuple[int, ...]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; records has virtual_slot and size."""
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, rows


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, shards, tuple(s % shards for s in range(slots)))


def traded(high: set[int], low: set[int], sizes: list[int], gap: int) -> tuple[int | None, int | None]:
    """The slots of a heavy and a light shard that, changing places, come nearest to halving the gap between them; None where none narrows it."""
    lighter = sorted((sizes[s], s) for s in low)
    best = (gap / 2, None, None)
    for given in sorted(high):
        at = bisect.bisect(lighter, (sizes[given] - gap / 2, -1))
        for size, taken in lighter[max(at - 1, 0) : at + 1]:
            best = min(best, (abs(sizes[given] - size - gap / 2), given, taken), key=lambda b: b[0])
    return best[1:]


def rebalanced(slot_map: SlotMap, sizes: list[int], shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
    """The map with as few edits as bring every shard within tolerance of the mean, where slots allow it.

    Moves the slot that helps most from the heaviest to the lightest shard, or, where each
    is too large, changes one for a smaller one of the lightest, until none helps. New shards start empty and so only receive. A shard that is too
    heavy and has no slot to give, as one slot alone outweighs the mean, is set aside,
    and the others go on towards the mean of what they hold.
    """
    shards = shards or slot_map.shards
    owner, loads = list(slot_map.owner), [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        loads[shard] += sizes[slot]
        members[shard].add(slot)
    going = set(range(shards))

    def move(slot: int, source: int, to: int) -> None:
        members[source].remove(slot)
        members[to].add(slot)
        owner[slot] = to
        loads[source] -= sizes[slot]
        loads[to] += sizes[slot]

    while going:
        high, low = max(going, key=lambda i: (loads[i], -i)), min(going, key=lambda i: (loads[i], i))
        gap, mean = loads[high] - loads[low], sum(loads[i] for i in going) / len(going)
        if loads[high] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance):
            break
        fits = [s for s in members[high] if 0 < sizes[s] < gap]
        given = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s), default=None)
        taken = None
        if given is None:
            given, taken = traded(members[high], members[low], sizes, gap)
        if given is None:
            going.remove(high)
            continue
        move(given, high, low)
        if taken is not None:
            move(taken, low, high)
    return replace(slot_map, version=slot_map.version + 1, shards=shards, owner=tuple(owner))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Store one version beside the earlier ones; a stored version is never written over."""
    rows = [(s, o, slot_map.shards) for s, o in enumerate(slot_map.owner)]
    df = spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1)
    df.write.mode("errorifexists").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the last."""
    df = spark.read.option("basePath", path).parquet(path)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(df.filter(F.col("version") == version).collect(), key=lambda r: r["slot"])
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def has_map(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def kept_map(spark: SparkSession, sizes: list[int], shards: int, path: str) -> SlotMap:
    """The data set's map: the last version stored at path, edited for these sizes and stored as a new version where that changes it.

    A data set without a map begins with the even one, stored as version 1.
    """
    slots = len(sizes)
    if not has_map(spark, path):
        save_map(spark, even_map(shards, slots), path)
    last = load_map(spark, path)
    if len(last.owner) != slots or last.shards > shards:
        raise ValueError(f"the map at {path} has {len(last.owner)} slots and {last.shards} shards")
    edited = rebalanced(last, sizes, shards)
    if (edited.shards, edited.owner) == (last.shards, last.owner):
        return last
    save_map(spark, edited, path)
    return load_map(spark, path, edited.version)


def placed(records: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """Add shard and the record's gapless position in it; records has virtual_slot, doc_id, size, text_crc32.

    Positions are numbered inside each virtual slot and shifted by the rows of the
    shard's earlier slots, so no shard is ever sorted as one group.
    """
    spark, begun, before = records.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.owner):
        before.append((slot, shard, begun[shard]))
        begun[shard] += rows[slot]
    where = spark.createDataFrame(before, "virtual_slot int, shard int, before long")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = records.withColumn("nth", F.row_number().over(w).cast("long") - 1)
    return numbered.join(F.broadcast(where), "virtual_slot").withColumn("position", F.col("before") + F.col("nth"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """Every document's shard under law ``bytes``; slot is its position in the shard."""
    return shard_documents(table(spark, sf_dir, "documents"), shards, slots, maps)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """Shard, position and size of every document.

    maps: the folder of the data set's stored maps, which is read, edited and stored
    again. Without one the documents are a new data set, whose maps are stored in the
    application's shared folder, so that results do not hang on earlier runs.
    """
    maps = maps or scratch_path(docs.sparkSession, "slot-maps")
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text_crc32").cast("string")))
    records = materialise(records.withColumn("virtual_slot", slot_of(key, slots)), "slots")
    sizes, rows = slot_loads(records, slots)
    slot_map = kept_map(docs.sparkSession, sizes, shards, maps)
    return placed(records, slot_map, rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )
