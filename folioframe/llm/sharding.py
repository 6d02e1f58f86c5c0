"""Sharding by fixed virtual slots.

A record hashes to one of a few thousand slots for good; a small, versioned map says which shard holds a
slot. Rebalancing adds up bytes per slot and edits the map: only whole slots move, no record is hashed
anew. The map has ``slots`` rows whatever the size of the data, so it may be collected and broadcast. A map
lives in a folder with one file set per version: ``shard`` starts from the latest version there, moves the
slots that the loads of the day ask for, and stores the result as the next version.

The law is ``bytes``: shards hold nearly the same number of bytes. Equal texts are told by ``text_crc32``
and ``size``; they are spread over the shards like other rows, by ``doc_id``, since one group of equal
texts may be larger than a shard.

Corner cases: a null text has size 1 (its separator) and the CRC of no bytes; a null ``doc_id`` hashes like
an empty one; repeated rows share a slot and get places of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.runtime import keep_until_exit, save, shared_root

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]``, with the version that a rebalancing raises."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, load: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version (or this one, if no slot moves): slots leave shards above the mean load for the
        least loaded ones.

        With more ``shards`` the new ones start empty, and slots move into them alone. Else moves go on
        while they bring the fullest and the emptiest shard closer; slots that need not move stay.
        """
        shards = shards or self.shards
        open_to = range(self.shards, shards) if shards > self.shards else range(shards)
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot in range(len(self.shard_of)):
            if load.get(slot):
                held[self.shard_of[slot] % shards].append(slot)
        total = [sum(load[s] for s in h) for h in held]
        mean = sum(total) / shards
        pool: list[int] = []
        for k in range(shards):
            held[k].sort(key=lambda s: (-load[s], s))
            for s in list(held[k]):
                if total[k] - load[s] >= mean:
                    held[k].remove(s)
                    total[k] -= load[s]
                    pool.append(s)
        for s in sorted(pool, key=lambda s: (-load[s], s)):
            k = min(open_to, key=lambda i: (total[i], i))
            held[k].append(s)
            total[k] += load[s]
        while shards <= self.shards and held[full := max(range(shards), key=lambda i: (total[i], -i))]:
            least = min(range(shards), key=lambda i: (total[i], i))
            gap = total[full] - total[least]
            give = min(held[full], key=lambda s: (abs(2 * load[s] - gap), s))
            best, move = abs(gap - 2 * load[give]), (give, None)
            small = sorted(held[least], key=lambda s: (load[s], s))
            sizes = [load[s] for s in small]
            for s in sorted(held[full]):  # or a swap, with one of the two slots next to the ideal size
                at = bisect.bisect_left(sizes, load[s] - gap / 2)
                for t in small[max(0, at - 1) : at + 1]:
                    if abs(gap - 2 * (load[s] - load[t])) < best:
                        best, move = abs(gap - 2 * (load[s] - load[t])), (s, t)
            if best >= gap:
                break
            for s, a, b in ((move[0], full, least), (move[1], least, full)):
                if s is not None:
                    held[a].remove(s)
                    held[b].append(s)
                    total[a] -= load[s]
                    total[b] += load[s]
        shard_of = [s % shards for s in self.shard_of]
        for k, h in enumerate(held):
            for s in h:
                shard_of[s] = k
        if shards == self.shards and tuple(shard_of) == self.shard_of:
            return self
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones; a version is never overwritten."""
        rows = [(self.version, self.shards, s, k) for s, k in enumerate(self.shard_of)]
        df = spark.createDataFrame(rows, "version int, shards int, slot int, shard int")
        df.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions stored under ``path``, oldest first; one that was not written to its end is none."""
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) if fs.exists(top) else []
        return sorted(int(re.search(r"version=(\d+)/", x.getPath().toString())[1]) for x in done)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Places every row: ``shard``, and its gapless ``slot`` (place) within the shard.

    Loads are summed per virtual slot (a combining aggregate of at most ``slots`` rows). The latest map under
    ``map_path`` (with the number of slots it was made for), or a first one, is edited for them; every new
    version is stored. A map without a ``map_path`` goes when the driver ends. A place is the count of rows
    in the shard's earlier virtual slots plus the rank within the own one, so no task sorts a whole shard,
    and texts are never shuffled.
    """
    spark = docs.sparkSession
    path, now = map_path, None
    if path is None:
        path = f"{shared_root(spark)}/folioframe-slot-map-{uuid.uuid4().hex}"
        keep_until_exit(spark, path)
    elif known := SlotMap.versions(spark, path):
        now = SlotMap.load(spark, path, known[-1])
    if now is None:
        now = SlotMap.first(shards, slots)
        now.store(spark, path)
    slots = len(now.shard_of)
    sized = save(with_slot(docs, slots), "sized")
    rows = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    load, count = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    final = now.rebalanced(load, shards)
    if final is not now:
        final.store(spark, path)
    base, placed = [0] * shards, []
    for s in range(slots):
        k = final.shard_of[s]
        placed.append((s, k, base[k]))
        base[k] += count.get(s, 0)
    table = spark.createDataFrame(placed, "virtual_slot int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return sized.withColumn("rank", rank).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(final.version).alias("map_version"),
    )
