"""Sharding by fixed virtual slots.

Every record hashes into one of SLOTS virtual slots; bytes and rows are aggregated per slot; a versioned map says
which shard holds each slot. Rebalancing and growing edit that map, never the hash, so a record moves only with its
slot. The map and the aggregates have SLOTS entries however many records there are, and are all that the driver
handles.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

SLOTS = 8192
#: Parts into which the records of a slot are dealt where they are counted off.
SPREAD = 16
#: Bytes that a record counts besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for one version; `edits` are the (slot, from, to) that made it from the version before."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = ()

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt round."""
    return SlotMap(1, shards, tuple(slot % shards for slot in range(slots)))


def rebalance(old: SlotMap, load: dict[int, int]) -> SlotMap:
    """The next version: slots move from the fullest to the emptiest shard while that lowers the larger of the two.

    Slots without load stay. Where no single slot helps the two shards exchange one each, and where that doesn't
    help either the fullest is left as it is. A slot moves at most a few times, and the result depends on the
    arguments alone.
    """
    shard_of = list(old.shard_of)
    held: list[set[int]] = [set() for _ in range(old.shards)]
    total = [0] * old.shards
    for slot, shard in enumerate(shard_of):
        if load.get(slot):
            held[shard].add(slot)
            total[shard] += load[slot]
    full = [(-t, s) for s, t in enumerate(total)]
    heapq.heapify(full)

    def move(slot: int, to: int) -> None:
        shard = shard_of[slot]
        held[shard].remove(slot)
        held[to].add(slot)
        total[shard] -= load[slot]
        total[to] += load[slot]
        shard_of[slot] = to

    for _ in range(4 * len(shard_of)):
        if not full:
            break
        weight, most = full[0]
        if -weight != total[most]:
            heapq.heapreplace(full, (-total[most], most))
            continue
        least = min(range(old.shards), key=lambda s: (total[s], s))
        gap = total[most] - total[least]
        # the best move leaves both nearest to half of the gap
        single = min(((abs(gap - 2 * load[s]), s) for s in held[most] if load[s] < gap), default=None)
        if single and single[0] < gap:
            move(single[1], least)
            heapq.heapreplace(full, (-total[most], most))
            heapq.heappush(full, (-total[least], least))
            continue
        pairs = ((abs(gap - 2 * (load[a] - load[b])), a, b) for a in held[most] for b in held[least] if 0 < load[a] - load[b] < gap)
        double = min(pairs, default=None)
        if double and double[0] < gap:
            move(double[1], least)
            move(double[2], most)
            heapq.heapreplace(full, (-total[most], most))
            heapq.heappush(full, (-total[least], least))
            continue
        heapq.heappop(full)
    edits = tuple((slot, a, b) for slot, (a, b) in enumerate(zip(old.shard_of, shard_of, strict=True)) if a != b)
    return SlotMap(old.version + 1, old.shards, tuple(shard_of), edits)


def grow(old: SlotMap, load: dict[int, int]) -> SlotMap:
    """The next version with one more shard, which takes slots up to its share from the fullest; no other moves."""
    shard_of, new = list(old.shard_of), old.shards
    total, held = [0] * new, [[] for _ in range(new)]
    for slot, shard in enumerate(shard_of):
        total[shard] += load.get(slot, 0)
        held[shard].append(slot)
    for own in held:
        own.sort(key=lambda s: (load.get(s, 0), s))
    share, taken = sum(total) / (new + 1), 0
    while taken < share:
        most = max(range(new), key=lambda s: (total[s], -s))
        if total[most] == 0 or not held[most]:
            break
        slot = held[most].pop()
        weight = load.get(slot, 0)
        if taken + weight > share + weight / 2 or not weight:
            break
        shard_of[slot] = new
        total[most] -= weight
        taken += weight
    edits = tuple((slot, a, b) for slot, (a, b) in enumerate(zip(old.shard_of, shard_of, strict=True)) if a != b)
    return SlotMap(old.version + 1, new + 1, tuple(shard_of), edits)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds a version to the table at `path`: (version, slot, shard)."""
    spark.createDataFrame(slot_map.rows(), "version long, slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard) of one version, the latest by default."""
    rows = spark.read.schema("slot int, shard int, version long").parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version).select("slot", "shard")


def latest_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The latest version at `path`; None where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema("slot int, shard int, version long").parquet(path)
    version = rows.agg(F.max("version")).first()[0]
    shard_of = [r["shard"] for r in rows.where(F.col("version") == version).orderBy("slot").collect()]  # one row a slot
    return SlotMap(version, max(shard_of) + 1, tuple(shard_of))


def edited(spark: SparkSession, path: str, shards: int, load: dict[int, int], slots: int = SLOTS) -> SlotMap:
    """The map at `path` brought to `shards` shards of near equal load, every version saved there: the first one if
    there is none, one for each shard by which it grows, and one for the moves that even the load out."""
    now = latest_map(spark, path)
    if now is None:
        now = first_map(shards, slots)
        save_map(spark, now, path)
    if len(now.shard_of) != slots or now.shards > shards:
        raise ValueError(f"the map at {path} has {len(now.shard_of)} slots and {now.shards} shards")
    while now.shards < shards:
        now = grow(now, load)
        save_map(spark, now, path)
    even = rebalance(now, load)
    if even.edits:
        save_map(spark, even, path)
        return even
    return now


def virtual_slot(*key: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    size is the UTF-8 length of the text (null: 0) plus OVERHEAD; text_crc32 is over the UTF-8 text (null counts as
    empty). The law is `bytes`: the map is edited until the shards' sizes are near equal, as near as whole slots
    allow. `slot` is the record's place in its shard, gapless from 0; grown_shard is null under this law. Records
    hash by id, together with size and crc where an id repeats a lot, so that no slot depends on one key alone: rows
    with a null or repeated id spread like others if their texts differ, and equal rows share a slot. Other columns
    aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = slim.withColumn("virtual_slot", virtual_slot("doc_id", "size", "text_crc32", slots=slots))
    # equal rows are dealt into SPREAD parts too: which of them gets which place doesn't matter
    slim = materialize(slim.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")), "shard-records")
    sums = slim.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sums = materialize(sums, "shard-slots")  # SLOTS * SPREAD rows at most
    load = {r["virtual_slot"]: r["bytes"] for r in sums.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()}
    path = map_path or new_path(spark, "slot-map")
    edited(spark, path, shards, load, slots)
    placed = load_map(spark, path).withColumnRenamed("slot", "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(placed), "virtual_slot").withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    starts = starts.select("virtual_slot", "part", "shard", "start")
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32"))
    return (
        slim.withColumn("nth", nth)
        .join(starts, ["virtual_slot", "part"])  # both are dealt by these keys; broadcast only where Spark finds it small
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of docs under path/shard=N as placed(doc_id, shard) says; rows with a null id have none."""
    own = placed.select(F.col("doc_id").alias(id_col), "shard").where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    docs.drop("shard").join(own, id_col).repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).write.partitionBy("shard").parquet(path)
