"""Sharding by fixed virtual slots.

Each record is hashed into one of thousands of virtual slots, bytes are added up per slot, and a small versioned
table maps slots to shards. Rebalancing writes that table's next version only; records never change their virtual slot.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, new_folder, written

SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 8
#: How far the fullest and the lightest shard may be apart, as a share of a mean shard, before slots are moved.
SLACK = 0.05
#: Repeats of one row that are hashed together.
REPEATS = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. ``bytes`` and ``rows`` are what the slots held when the map was made."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes: tuple[int, ...] = field(repr=False)
    rows: tuple[int, ...] = field(repr=False)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.bytes[slot]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table, with ``first``: how many rows of the same shard lie in smaller slots."""
        seen, rows = [0] * self.shards, []
        for slot, shard in enumerate(self.shard_of):
            rows.append((self.shards, slot, shard, self.bytes[slot], self.rows[slot], seen[shard]))
            seen[shard] += self.rows[slot]
        return spark.createDataFrame(rows, "shards int, virtual_slot int, shard int, bytes long, rows long, first long")

    def store(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the table under ``folder``; a version that is there already is an error.

        It is written under a hidden name and renamed when it is whole: a writer that dies leaves no version.
        """
        fs, path = _files(spark, folder)
        if self.version in _versions(spark, folder):
            raise FileExistsError(f"{folder} has version {self.version}")
        hidden, final = f"{folder}/.{uuid.uuid4().hex}", path(f"{folder}/version={self.version}")
        self.frame(spark).coalesce(1).write.parquet(hidden)
        fs.delete(final, True)  # of a writer that died
        if not fs.rename(path(hidden), final):
            raise FileExistsError(f"{folder}: version {self.version} was written meanwhile")

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
        """The newest whole version (or a given one) of the table under ``folder``, None if there is none."""
        version = version if version is not None else max(_versions(spark, folder), default=None)
        if version is None:
            return None
        rows = sorted(spark.read.parquet(f"{folder}/version={version}").collect(), key=lambda r: r.virtual_slot)  # one a slot
        return cls(version, rows[0].shards, *(tuple(r[c] for r in rows) for c in ("shard", "bytes", "rows")))


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and what makes its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions under ``folder`` that are whole; a folder that can't be read is an error."""
    fs, path = _files(spark, folder)
    if not fs.exists(path(folder)):
        return []
    found = (s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("version="))
    return [int(p.getName().removeprefix("version=")) for p in found if fs.exists(path(p, "_SUCCESS"))]


def balanced(bytes_: list[int], rows: list[int], shards: int) -> SlotMap:
    """Version 1 of a map: heaviest slot first, each to the lightest shard so far (ties: smaller number)."""
    heap, shard_of = [(0, s) for s in range(shards)], [0] * len(bytes_)
    for slot in sorted(range(len(bytes_)), key=lambda s: (-bytes_[s], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + bytes_[slot], shard))
    return SlotMap(1, shards, tuple(shard_of), tuple(bytes_), tuple(rows))


def grown(old: SlotMap, shards: int) -> SlotMap:
    """The next version with more shards: slots move only into new shards, always from the fullest shard."""
    shard_of, loads = list(old.shard_of), old.loads() + [0] * (shards - old.shards)
    target = sum(loads) / shards
    held: dict[int, list[int]] = {s: [] for s in range(old.shards)}
    for slot in sorted(range(len(shard_of)), key=lambda s: (old.bytes[s], s)):
        held[shard_of[slot]].append(slot)
    for new in range(old.shards, shards):
        while True:
            fullest = max(range(old.shards), key=lambda s: (loads[s], -s))
            fits = [s for s in held[fullest] if 0 < old.bytes[s] <= target - loads[new]]
            if not fits or loads[fullest] <= target:
                break
            slot = fits[-1]
            held[fullest].remove(slot)
            shard_of[slot], loads[fullest], loads[new] = new, loads[fullest] - old.bytes[slot], loads[new] + old.bytes[slot]
    return SlotMap(old.version + 1, shards, tuple(shard_of), old.bytes, old.rows)


def rebalanced(old: SlotMap, slack: float = SLACK) -> SlotMap:
    """The next version with the same shards: slots move from the fullest to the lightest shard; the same map if those are near enough."""
    shard_of, loads = list(old.shard_of), old.loads()
    most = slack * sum(loads) / old.shards
    held: list[list[int]] = [[] for _ in loads]
    for slot in sorted(range(len(shard_of)), key=lambda s: (old.bytes[s], s)):
        held[shard_of[slot]].append(slot)
    moved = False
    while True:
        full, light = max(range(old.shards), key=lambda s: (loads[s], -s)), min(range(old.shards), key=lambda s: (loads[s], s))
        fits = [s for s in held[full] if 0 < old.bytes[s] <= (loads[full] - loads[light]) / 2]
        if loads[full] - loads[light] <= most or not fits:
            break
        slot, moved = fits[-1], True
        held[full].remove(slot)
        held[light].append(slot)
        held[light].sort(key=lambda s: (old.bytes[s], s))
        shard_of[slot], loads[full], loads[light] = light, loads[full] - old.bytes[slot], loads[light] + old.bytes[slot]
    return replace(old, version=old.version + 1, shard_of=tuple(shard_of)) if moved else old


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row; a null text has no bytes."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # repeated rows are counted, and hashed some at a time: neither a task nor a slot gets all of them
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    some = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))).alias("salt"))
    named = F.concat_ws(":", F.col("doc_id").cast("string"), "text_crc32", "size", F.when(F.col("salt") > 0, F.concat(F.lit("+"), F.col("salt").cast("string"))))
    slot = F.pmod(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")
    times = F.least(F.col("n") - F.col("salt") * REPEATS, F.lit(REPEATS)).cast("int")
    return some.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot of what ``slotted`` returned. The driver gets one row per slot, never more than ``slots``."""
    bytes_, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        bytes_[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return bytes_, count


def assigned(rows: DataFrame, smap: SlotMap) -> DataFrame:
    """Each row's shard by the map, and its gapless place in that shard: by virtual slot, then id, then crc."""
    place = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    held = F.broadcast(smap.frame(rows.sparkSession).select("virtual_slot", "shard", "first"))
    return (
        rows.withColumn("at", F.row_number().over(place).cast("long"))
        .join(held, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Shards of near-equal bytes. Returns the rows with their shards, and the slot map, whose versions are stored under ``folder``.

    A map that is stored there already is kept, so that records stay where they are: with more shards than it has it
    is grown, and where shards have come to differ by more than ``SLACK`` it is rebalanced; either way only some slots
    move, and the next version is stored. Without ``folder``, a new one is used.

    Sizes are equal up to the largest virtual slot. Nulls: a null text counts no bytes but the overhead; null ids are
    an id like others. Repeated rows (same id, size and checksum) are spread, 16 to a virtual slot, and get places of
    their own. An empty table gives no rows. Other columns are ignored. Only ids, sizes and checksums are shuffled, never texts.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "slot-map")
    rows = written(slotted(docs, id_col, text_col, slots), "slotted")
    bytes_, count = slot_totals(rows, slots)
    old = SlotMap.stored(spark, folder)
    if old is None:
        balanced(bytes_, count, shards).store(spark, folder)
    else:
        if len(old.shard_of) != slots or shards < old.shards:
            raise ValueError(f"the stored map has {len(old.shard_of)} slots and {old.shards} shards")
        now = replace(old, bytes=tuple(bytes_), rows=tuple(count))
        new = grown(now, shards) if shards > old.shards else rebalanced(now)
        if new is not now:
            new.store(spark, folder)
    smap = replace(SlotMap.stored(spark, folder), bytes=tuple(bytes_), rows=tuple(count))
    return assigned(rows, smap), smap
