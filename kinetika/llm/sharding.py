"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of virtual slots. The bytes of each slot are summed, a versioned map sends slots to
shards, and a rebalance edits that map alone: records of a slot always move together, and no record is hashed again. Version 1 deals the
slots out in turn, before any bytes are known; version 2 is version 1 rebalanced to the bytes found, and rows are placed by it.

Defined results: a null text counts no bytes; a null id hashes like any other value; rows that repeat an id share its virtual slot, and so
its shard, however many they are; equal rows take places next to each other in no fixed order; a very long text is one record; an
empty table gives no rows and maps of empty slots; input columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetika.session import materialize, new_folder

SLOTS = 4096
ROW_OVERHEAD = 16
#: Rows of a virtual slot that one task numbers.
PART_ROWS = 50_000


@dataclass
class SlotMap:
    """Which shard holds each virtual slot, at one version."""

    version: int
    shards: int
    shard_of: list[int]
    size_of: list[int] = field(repr=False)

    @classmethod
    def start(cls, slots: int, shards: int) -> SlotMap:
        """Version 1: slots dealt out in turn, as long as nothing is known of their bytes."""
        return cls(1, shards, [slot % shards for slot in range(slots)], [0] * slots)

    def rebalance(self, sizes: list[int], tolerance: float = 1e-4) -> SlotMap:
        """The next version, edited for the bytes that the slots have now.

        The fullest shard gives the emptiest a slot, or swaps one with it, whichever comes nearest to half their difference, until
        they differ by ``tolerance`` of the mean load or no move helps. A shard that nothing helps is left out of account.
        """
        moved, loads = list(self.shard_of), [0] * self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(moved):
            loads[shard] += sizes[slot]
            held[shard].append((sizes[slot], slot))
        for slots in held:
            slots.sort()
        enough, open_shards = max(1.0, tolerance * sum(sizes) / self.shards), set(range(self.shards))
        while len(open_shards) > 1:
            full = max(open_shards, key=lambda s: (loads[s], -s))
            empty = min(open_shards, key=lambda s: (loads[s], s))
            gap = loads[full] - loads[empty]
            if gap <= enough:
                break
            best: tuple | None = None
            for given in held[full]:
                if given[0] and given[0] < gap:
                    best = min(filter(None, (best, (abs(gap - 2 * given[0]), given, None))), key=lambda x: x[0])
                at = bisect.bisect_left(held[empty], (given[0] - gap / 2, -1))
                for taken in held[empty][max(0, at - 1) : at + 1]:
                    if 0 < given[0] - taken[0] < gap:
                        best = min(filter(None, (best, (abs(gap - 2 * (given[0] - taken[0])), given, taken))), key=lambda x: x[0])
            if best is None:
                open_shards.discard(full)
                continue
            for item, source, target in ((best[1], full, empty), (best[2], empty, full)):
                if item:
                    held[source].remove(item)
                    bisect.insort(held[target], item)
                    moved[item[1]] = target
                    loads[source] -= item[0]
                    loads[target] += item[0]
        return SlotMap(self.version + 1, self.shards, moved, list(sizes))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.size_of[slot]
        return out

    def grow(self) -> SlotMap:
        """The next version, with one more shard: slots move to the new shard alone, from the fullest shards."""
        new, moved = self.shards, list(self.shard_of)
        goal = sum(self.size_of) / (self.shards + 1)
        loads, mine = self.loads(), 0
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot in sorted(range(len(moved)), key=lambda s: (self.size_of[s], -s)):
            held[moved[slot]].append(slot)
        heap = [(-load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        while mine < goal and heap:
            load, shard = heapq.heappop(heap)
            if not held[shard] or mine + self.size_of[held[shard][-1]] > goal * 1.0001 + 1:
                if len(held[shard]) > 1:
                    held[shard].pop()
                    heapq.heappush(heap, (load, shard))
                continue
            slot = held[shard].pop()
            moved[slot] = new
            mine += self.size_of[slot]
            heapq.heappush(heap, (load + self.size_of[slot], shard))
        return SlotMap(self.version + 1, new + 1, moved, self.size_of)

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.version, slot, shard, self.size_of[slot]) for slot, shard in enumerate(self.shard_of)]

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the maps stored in ``folder``; a version is written once."""
        frame = spark.createDataFrame(self.rows(), "version int, virtual_slot int, shard int, slot_bytes long")
        frame.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        found = spark.read.parquet(f"{folder}/version={version}").select("virtual_slot", "shard", "slot_bytes").orderBy("virtual_slot").collect()
        return cls(version, max((r.shard for r in found), default=0) + 1, [r.shard for r in found], [r.slot_bytes for r in found])


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Place every row of ``docs`` in a shard; shards get about equal bytes (law ``bytes``).

    Returns the key, ``size`` (UTF-8 bytes plus 16), ``text_crc32`` (null text: of no bytes), ``law``, ``shard``, ``slot`` (the
    row's place in its shard, gapless from 0), ``grown_shard`` (null under this law), ``virtual_slot`` and ``map_version``. The maps
    are stored in ``folder`` (by default a new one in the shared folder), and the last is read back from there.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(key).alias("id"), (F.octet_length(whole).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), virtual_slot(F.col(key), slots).alias("virtual_slot"),
            F.monotonically_increasing_id().alias("salt"),
        ),
        "shard-rows",
    )
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # one row per slot
    sizes, parts = [0] * slots, [(r.virtual_slot, -(-r.n // PART_ROWS)) for r in found]
    for r in found:
        sizes[r.virtual_slot] = r.bytes
    folder = folder or new_folder(spark, "slot-maps")
    first_map = SlotMap.start(slots, shards)
    first_map.save(spark, folder)
    first_map.rebalance(sizes).save(spark, folder)
    current = SlotMap.load(spark, folder, first_map.version + 1)

    # A slot of many rows is numbered in parts, each after the one before.
    dealt = rows.join(F.broadcast(spark.createDataFrame(parts, "virtual_slot int, parts int")), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("salt"), F.col("parts").cast("long")).cast("int"))
    counts = dealt.groupBy("virtual_slot", "part").count().collect()  # one row per slot, and per PART_ROWS rows
    firsts, filled = [], [0] * shards
    for slot, part, n in sorted((r.virtual_slot, r.part, r["count"]) for r in counts):
        at = current.shard_of[slot]
        firsts.append((slot, part, at, filled[at]))
        filled[at] += n
    places = spark.createDataFrame(firsts, "virtual_slot int, part int, shard int, first long")
    within = Window.partitionBy("virtual_slot", "part").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(places), ["virtual_slot", "part"])
        .select(
            F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(current.version).alias("map_version"),
        )
    )
