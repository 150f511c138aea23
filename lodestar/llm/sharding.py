"""Sharding by fixed virtual slots; the law is `bytes`: the shards' sizes are near equal.

A row belongs to one of SLOTS virtual slots by a hash of its text, so that equal texts share a slot and a shard.
The bytes of each slot are added up, and a versioned table maps slots to shards: the first version gives the
largest slot left to the lightest shard; a later version is an edit that moves no slot without need. report() writes the first version into the
shared folder, and places rows by the version that it reads there. A
group of equal texts larger than SPLIT of a shard's fair share is spread over as many slots as it takes,
by doc_id.

A row's size is the UTF-8 bytes of its text, none for null, plus ROW. Null texts are equal. Repeated rows are
rows of their own; those with equal doc_id and text are told apart in no defined order. An empty
table has a map all the same, of slots without bytes. Very long texts are weighed whole. Ids may be of any type that can be
sorted. Other columns are passed through by assign(), whose own get underscores if a name is taken.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import new_path, stored, unused

SLOTS, SHARDS, ROW, SPLIT = 8192, 24, 8, 0.5


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: the shard of each slot, and the slots over which each large group is spread."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    spread: dict[int, int] = field(default_factory=dict)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Writes this version beside the earlier ones."""
        row = [(self.version, self.shards, list(self.shard_of), json.dumps({str(k): v for k, v in self.spread.items()}))]
        spark.createDataFrame(row, "version int, shards int, shard_of array<int>, spread string").coalesce(1).write.mode("append").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The version asked for, or else the latest."""
        rows = spark.read.parquet(folder)
        row = (rows.where(F.col("version") == version) if version is not None else rows).orderBy(F.desc("version")).first()
        if row is None:
            raise LookupError(f"no version {version} in {folder}")
        return SlotMap(row[0], row[1], tuple(row[2]), {int(k): v for k, v in json.loads(row[3]).items()})

    def rebalanced(self, load: dict[int, int], shards: int | None = None, tolerance: float = 0.05) -> SlotMap:
        """The next version, for these bytes of each slot and this number of shards.

        Slots of shards that are gone are placed anew. New shards are filled to the mean from the heaviest ones.
        Then, while a shard is off the mean by more than tolerance, the slot moves from the heaviest to the
        lightest that brings the two nearest. No other slot moves.
        """
        count = shards or self.shards
        of = list(self.shard_of)
        total = [0] * count
        for slot, size in load.items():
            if of[slot] < count:
                total[of[slot]] += size
        for slot in sorted((s for s in range(len(of)) if of[s] >= count), key=lambda s: (-load.get(s, 0), s)):
            of[slot] = min(range(count), key=lambda k: (total[k], k))
            total[of[slot]] += load.get(slot, 0)
        held: list[set[int]] = [set() for _ in range(count)]
        for slot, shard in enumerate(of):
            if load.get(slot, 0):
                held[shard].add(slot)
        mean = sum(total) / count

        def move(slot: int, to: int) -> None:
            held[of[slot]].remove(slot), held[to].add(slot)
            total[of[slot]] -= load[slot]
            total[to] += load[slot]
            of[slot] = to

        for new in range(self.shards, count):
            while True:
                high = max(range(self.shards), key=lambda k: (total[k], -k))
                fit = [s for s in held[high] if load[s] <= min(mean - total[new], total[high] - mean * (1 - tolerance))]
                if not fit:
                    break
                move(max(fit, key=lambda s: (load[s], -s)), new)
        for _ in range(len(of)):
            high, low = max(range(count), key=lambda k: (total[k], -k)), min(range(count), key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            fit = [s for s in held[high] if load[s] < gap]
            if total[high] <= mean * (1 + tolerance) and total[low] >= mean * (1 - tolerance) or not fit:
                break
            move(min(fit, key=lambda s: (abs(gap / 2 - load[s]), s)), low)
        return SlotMap(self.version + 1, count, tuple(of), self.spread)


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW).cast("long")


def _text_hash() -> Column:
    return F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long")


def virtual_slot(text_hash: Column, spread: dict[int, int], slots: int) -> Column:
    """The slot of a row with that hash and the column doc_id. spread has an entry for each large group only, of which
    there are less than shards / SPLIT."""
    many = F.lit(1).cast("long")
    if spread:
        table = F.create_map(*[F.lit(x) for k, v in spread.items() for x in (k, int(v))])
        many = F.coalesce(table[text_hash], F.lit(1)).cast("long")
    salt = F.when(many > 1, F.pmod(F.xxhash64("doc_id", F.lit("slot")), many)).otherwise(F.lit(0).cast("long"))
    return F.pmod(F.xxhash64(text_hash, salt), F.lit(slots)).cast("int")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and text_hash of every row: all that placing takes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", size_of().alias("size"), F.crc32(text).cast("long").alias("text_crc32"), _text_hash().alias("text_hash"))


def with_slots(rows: DataFrame, spread: dict[int, int], slots: int) -> DataFrame:
    """narrow() rows with their virtual_slot."""
    return rows.withColumn("virtual_slot", virtual_slot(F.col("text_hash"), spread, slots))


def first_map(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1 for these narrow() rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, total / shards * SPLIT)
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).collect()
    spread = {row[0]: min(slots, int(row[1] / most * 4) + 1) for row in groups}
    load = slot_bytes(with_slots(rows, spread, slots))
    of, heap = [0] * slots, [(0, k) for k in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-load.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        of[slot] = shard
        heapq.heappush(heap, (size + load.get(slot, 0), shard))
    return SlotMap(1, shards, tuple(of), spread)


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """The bytes of each slot that has any: slots many numbers at most."""
    return {row[0]: row[1] for row in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def placed(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """narrow() rows with virtual_slot, shard and slot, the row's place in its shard."""
    spark = rows.sparkSession
    slots = len(slot_map.shard_of)
    rows = with_slots(rows, slot_map.spread, slots)
    shard_of = spark.createDataFrame([(s, k) for s, k in enumerate(slot_map.shard_of)], "virtual_slot int, shard int")
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("_n")).join(F.broadcast(shard_of), "virtual_slot")  # slots rows at most
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_hash"))
    return rows.withColumn("_nth", nth).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("_before") + F.col("_nth") - 1).drop("_before", "_nth")


def assign(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """docs with the columns virtual_slot and shard, to be written by shard."""
    slot, shard = unused(docs, "virtual_slot"), unused(docs, "shard")
    of = docs.select("*", virtual_slot(_text_hash(), slot_map.spread, len(slot_map.shard_of)).alias(slot))
    shard_of = docs.sparkSession.createDataFrame([(s, k) for s, k in enumerate(slot_map.shard_of)], f"`{slot}` int, `{shard}` int")
    return of.join(F.broadcast(shard_of), slot).select(*docs.columns, slot, shard)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version of every row."""
    spark = docs.sparkSession
    rows = stored(narrow(docs), "sizes")
    folder = new_path(spark, "slot-map")
    first_map(rows, shards).save(spark, folder)
    slot_map = SlotMap.load(spark, folder)
    out = placed(rows, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
