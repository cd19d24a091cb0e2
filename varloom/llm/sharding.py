"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Every record is hashed into one of a few thousand fixed slots; the slot of a
record never changes.  Bytes are summed per slot, and a small map (one row a
slot) says which shard holds each slot.  The first map deals the slots out
largest first to the lightest shard, so that shards hold nearly equal bytes.
Rebalancing edits the map: slots move from heavy shards to light or new ones,
and each edit is stored as a new version beside the old ones.

Only DataFrame functions run on the executors; the driver sees one number a
slot.  Null text counts as no bytes, a null doc_id hashes like any value, and
repeated rows are separate records (in one slot, unless they are very many).  No rows give no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.llm._shared import materialize, with_output

SLOTS = 4096
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, in one version."""

    version: int
    n_shards: int
    shard: tuple[int, ...]  # by slot

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, v, s) for v, s in enumerate(self.shard)], "version int, n_shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the others, in a folder of its own: saving it again replaces it, others stay."""
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).select("vslot", "shard", "n_shards").collect()  # one row a slot
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in sorted(rows)))

    @staticmethod
    def deal(weight: list[int], n_shards: int) -> SlotMap:
        """Largest slot first, to the shard with the fewest bytes so far."""
        heap = [(0, s) for s in range(n_shards)]
        shard = [0] * len(weight)
        for v in sorted(range(len(weight)), key=lambda v: (-weight[v], v)):
            held, s = heapq.heappop(heap)
            shard[v] = s
            heapq.heappush(heap, (held + weight[v], s))
        return SlotMap(1, n_shards, tuple(shard))

    def rebalance(self, weight: list[int], n_shards: int, tolerance: float = 0.01) -> SlotMap:
        """The next version: as few slots as needed move until loads are within the tolerance.

        Slots of shards that no longer exist move first.  Each move takes a
        slot from the heaviest shard to the lightest and lessens their gap.
        """
        shard = list(self.shard)
        load = [0] * n_shards
        for v, s in enumerate(shard):
            if s < n_shards:
                load[s] += weight[v]
        for v in sorted((v for v, s in enumerate(shard) if s >= n_shards), key=lambda v: (-weight[v], v)):
            to = min(range(n_shards), key=lambda s: (load[s], s))
            shard[v] = to
            load[to] += weight[v]
        mean = sum(weight) / n_shards
        while True:
            high = max(range(n_shards), key=lambda s: (load[s], -s))
            low = min(range(n_shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            fits = [v for v, s in enumerate(shard) if s == high and 0 < weight[v] < gap]
            if gap <= tolerance * mean or not fits:
                return SlotMap(self.version + 1, n_shards, tuple(shard))
            v = min(fits, key=lambda v: (abs(2 * weight[v] - gap), v))
            shard[v] = low
            load[high] -= weight[v]
            load[low] += weight[v]


def rebalance(spark: SparkSession, path: str, weight: list[int], n_shards: int, tolerance: float = 0.01) -> SlotMap:
    """Edit the latest stored map for these weights and this number of shards, and store the next version."""
    SlotMap.load(spark, path).rebalance(weight, n_shards, tolerance).save(spark, path)
    return SlotMap.load(spark, path)


def records(df: DataFrame, *, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row: the narrow table that all later steps read, written once.

    A record whose repeated rows would fill a good part of a slot by
    themselves is dealt to all slots, row by row.
    """
    t = F.col(f"`{text}`")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary"))
    rows = materialize(df.select(F.col(f"`{key}`").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("_at")), "records")
    bar = max(1024, rows.count() // (8 * slots))
    often = rows.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bar)
    often = often.select(F.struct("doc_id", "text_crc32").alias("_k"), F.lit(True).alias("_often"))
    held = rows.withColumn("_k", F.struct("doc_id", "text_crc32")).join(F.broadcast(often), "_k", "left")  # at most 8 keys a slot
    slot = F.expr(f"cast(pmod(if(_often, xxhash64(doc_id, text_crc32, _at), xxhash64(doc_id, text_crc32)), {slots}) as int)")
    return held.withColumn("_often", F.coalesce("_often", F.lit(False))).select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot, by slot; `slots` numbers come to the driver."""
    got = dict(recs.groupBy("vslot").agg(F.sum("size")).collect())
    return [got.get(v, 0) for v in range(slots)]


def place(recs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Add shard and slot: the gapless position of the row in its shard.

    A shard is the concatenation of its virtual slots; a row's position is
    its slot's start plus its row number inside the slot.
    """
    spark = recs.sparkSession
    where = F.broadcast(slot_map.frame(spark).select("vslot", "shard"))  # one row a slot
    counts = recs.groupBy("vslot").agg(F.count(F.lit(1)).alias("_n")).join(where, "vslot")  # at most one row a slot
    starts = counts.withColumn("_from", F.sum("_n").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))).select("vslot", "shard", F.coalesce("_from", F.lit(0)).alias("_from"))
    numbered = recs.withColumn("_i", F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1)
    return with_output(numbered.join(F.broadcast(starts), "vslot"), shard=F.col("shard"), slot=(F.col("_from") + F.col("_i")).cast("long")).drop("_from", "_i")


def shard_documents(df: DataFrame, n_shards: int = 40, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Records with shard and slot under a first map (stored at `map_path` and read back if given)."""
    recs = records(df, slots=slots)
    first = SlotMap.deal(slot_bytes(recs, slots), n_shards)
    if map_path:
        first.save(df.sparkSession, map_path)
        first = SlotMap.load(df.sparkSession, map_path, first.version)
    return place(recs, first)
