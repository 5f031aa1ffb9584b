"""Sharding over fixed virtual slots, with a versioned slot-to-shard map edited when rebalancing.

Records hash into SLOTS virtual slots for good; records that repeat carry an occurrence number
in the hash, so that any number of equal rows spreads over the slots. Bytes are summed a slot,
and a stored map sends each slot to a shard. Version 1 knows no loads: equal runs of slots.
Moving a slot is an edit of the map that makes its next version, and moves no record of any
other slot.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, shared_dir

SLOTS = 4096
COPIES = 10_000  #: equal rows numbered in one task
PART_ROWS = 50_000  #: rows of a slot that are ordered together, about


@dataclass(frozen=True)
class SlotMap:
    """slot -> shard, the version, and the moves (slot, from, to) that made it from the last one."""

    shards: int
    of: tuple[int, ...]
    version: int = 1
    moves: tuple[tuple[int, int, int], ...] = field(default=())

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: equal runs of slots."""
        return SlotMap(shards, tuple(i * shards // slots for i in range(slots)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(slot, shard) for slot, shard in enumerate(self.of)], "vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map's folder, with its moves; a version saved before is never changed (raises)."""
        came = {slot: a for slot, a, _ in self.moves}
        rows = [(slot, shard, came.get(slot), self.shards) for slot, shard in enumerate(self.of)]
        spark.createDataFrame(rows, "vslot int, shard int, moved_from int, shards int").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A saved version, or the last one."""
        table = spark.read.option("basePath", path).parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = sorted((r["vslot"], r["shard"], r["moved_from"], r["shards"]) for r in table.where(F.col("version") == version).collect())
        if not rows:
            raise ValueError(f"no version {version} at {path}")
        return SlotMap(rows[0][3], tuple(r[1] for r in rows), version, tuple((r[0], r[2], r[1]) for r in rows if r[2] is not None))


def rebalanced(old: SlotMap, loads: list[int], shards: int | None = None) -> SlotMap:
    """The next version for new loads or a new number of shards, by moves of single slots.

    Slots leave shards that are gone. Then, time and again, the heaviest shard that can gives the
    lightest the slot that brings the two closest together. At the end no shard differs from the
    lightest by more than its own least loaded slot holds.
    """
    shards = shards or old.shards
    of, have, held = list(old.of), [0] * shards, [set() for _ in range(shards)]
    for slot, s in enumerate(of):
        if s < shards:
            have[s] += loads[slot]
            held[s].add(slot)
    for slot in sorted((i for i, s in enumerate(of) if s >= shards), key=lambda i: (-loads[i], i)):
        s = min(range(shards), key=lambda j: (have[j], j))
        of[slot], have[s] = s, have[s] + loads[slot]
        held[s].add(slot)
    while True:
        b = min(range(shards), key=lambda j: (have[j], j))
        for a in sorted(range(shards), key=lambda j: (-have[j], j)):
            gap = have[a] - have[b]
            slot = min((i for i in held[a] if 0 < loads[i] < gap), key=lambda i: (abs(gap - 2 * loads[i]), i), default=None)
            if slot is not None:
                break
        else:
            break
        of[slot], have[a], have[b] = b, have[a] - loads[slot], have[b] + loads[slot]
        held[a].remove(slot)
        held[b].add(slot)
    moves = tuple((i, s, t) for i, (s, t) in enumerate(zip(old.of, of)) if s != t)
    return SlotMap(shards, tuple(of), old.version + 1, moves)


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, h): bytes of the text (null: none) plus 8; the record's slot, and its hash.

    Rows equal in these columns are counted before anything is shuffled, and numbered as they
    are written out again, COPIES at a time: no task holds a group of equal rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("doc_id"), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    first = same.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    many = first.where(F.col("n") > COPIES).repartition("doc_id", "text_crc32", "at")
    each = first.where(F.col("n") <= COPIES).unionByName(many).withColumn("nth", F.explode(F.expr(f"sequence(at, least(at + {COPIES}, n) - 1)")))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "nth")
    return each.select("doc_id", "size", "text_crc32", h.alias("h")).select("doc_id", "size", "text_crc32", F.pmod("h", F.lit(slots)).cast("int").alias("vslot"), "h")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; one row a slot reaches the driver."""
    out = [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("n")).collect():
        out[r["vslot"]] = r["n"]
    return out


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, slot_map: SlotMap | None = None, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place in its shard, from 0) of every row.

    slot_map is used as it is; it must have ``slots`` slots (else raises), and may leave shards
    empty. Without one, the last version of the map stored at path (by default a new folder in
    the shared one, with a version 1 of equal runs of slots) is loaded, edited to even out the
    shards' bytes as they are now, stored as the next version, and read back. Equal rows may lie in different
    shards. Null ids and texts hash like empty ones. An empty table gives no rows. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    records = settled(with_slots(docs, slots))
    if slot_map is None:
        if path is None:
            path = f"{shared_dir(spark).rstrip('/')}/factloom-slots-{uuid.uuid4().hex}"
            SlotMap.even(shards, slots).save(spark, path)
        rebalanced(SlotMap.load(spark, path), slot_loads(records, slots), shards).save(spark, path)
        slot_map = SlotMap.load(spark, path)
    if len(slot_map.of) != slots:
        raise ValueError(f"a map of {len(slot_map.of)} slots for records of {slots}")
    homes = F.broadcast(slot_map.frame(spark))  # as many rows as slots, at any input size
    # a slot's rows are numbered in parts of its hashes, and parts by sums over those before
    parts = max(1, -(-records.count() // (slots * PART_ROWS)))
    records = records.withColumn("part", F.pmod(F.shiftright("h", 16), F.lit(parts)))
    counts = records.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(homes, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "h")
    placed = records.withColumn("nth", F.row_number().over(within)).join(F.broadcast(base) if parts == 1 else base, ["vslot", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("bigint").alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
