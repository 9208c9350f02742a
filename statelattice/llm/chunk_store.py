"""A content-addressed store of byte strings cut into content-defined chunks.

Writing:

1. every item is cut and hashed once: its recipe is the list of its chunks' digests and sizes under a Merkle root.
   Items and recipes go to a scratch table in which each row has a number of its own;
2. aggregates over digests alone elect the row that holds each distinct item and the (row, place) that holds each
   distinct chunk, the least numbers. All joins are on row numbers, which are unique, so neither repeated keys, null
   keys nor frequent chunks multiply rows or meet in one task;
3. one row is stored for every item, in the order asked for: its recipe, the chunks that it alone has (`own`), and
   under `given` those that it holds for others as well. Copies of an item store their recipe alone. So each distinct
   chunk is in the store once, whatever repeats. The scratch table is then deleted.

Reading uses the store's files only: given chunks are joined to the recipes that lack them, the rest is put together
from the item's own row, and every chunk's digest, the Merkle root and the item's SHA-256 are checked.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_spread, materialize, new_path

DIGEST = 20
#: Bytes of a table of exceptions up to which it may be broadcast.
BROADCAST_BYTES = 16 << 20
_state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_state = (_state ^ (_state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
#: One pseudorandom 32-bit number per byte value (a splitmix step of its index).
GEAR = ((_state ^ (_state >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


def gear_cuts(data: bytes, unit: int = 1, bits: int = 12, least: int = 1024, most: int = 32768) -> list[int]:
    """Ends of the chunks of data, each a multiple of `unit` bytes but perhaps for the last.

    A chunk ends where the top `bits` bits of the gear hash of the 32 bytes before are 0, not before `least`
    bytes and at `most` bytes at the latest. Empty data has no chunks.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # sum of GEAR << age over the last 32 bytes, by doubling
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ends = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    if unit > 1:
        ends = ends[ends % unit == 0]
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(ends, at + least)
        end = min(int(ends[i]) if i < len(ends) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Root over the digests; an odd last node is taken up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in digests] or [bytes(DIGEST)]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def manifest(size: int, root: bytes, digests: list[bytes], sizes: list[int]) -> bytes:
    """An item's recipe as bytes."""
    return b"CDC1" + struct.pack("<QI", size, len(digests)) + root + b"".join(d + struct.pack("<I", n) for d, n in zip(digests, sizes, strict=True))


@dataclass(frozen=True)
class Store:
    """A written store: one row for each item at `path`."""

    path: str
    order: tuple[str, ...] = ()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_ROW).parquet(self.path)

    def recipes(self, spark: SparkSession) -> DataFrame:
        """(key, note, size, sha, file, place) of every item, as the files have them: `place` counts a file's rows."""
        at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")]
        return self.rows(spark).select("key", "note", "size", "sha", *at)


_ROW = (
    "key long, note long, size long, sha binary, root binary, digests array<binary>, sizes array<int>, copy boolean, "
    "own array<binary>, given array<struct<digest: binary, chunk: binary>>"
)

#: Arrow types of what describe() gives.
DESCRIBED = {"size": pa.int64(), "sha": pa.binary(), "root": pa.binary(), "digests": pa.list_(pa.binary()), "sizes": pa.list_(pa.int32())}
ITEMS = "key long, note long, data binary, size long, sha binary, root binary, digests array<binary>, sizes array<int>"


def describe(data: bytes, cuts: Callable[[bytes], list[int]]) -> tuple[int, bytes, bytes, list[bytes], list[int]]:
    """An item's recipe: size, sha, root, digests, sizes."""
    ends = cuts(data)
    sha = hashlib.sha256(data).digest()
    if len(ends) < 2:
        digests = [digest(data)] if ends else []
        return len(data), sha, merkle_root(digests), digests, ends
    starts = [0, *ends[:-1]]
    digests = [digest(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    return len(data), sha, merkle_root(digests), digests, [b - a for a, b in zip(starts, ends, strict=True)]


def item_batch(keys: pa.Array, notes: pa.Array, data: list[bytes], cuts: Callable[[bytes], list[int]]) -> pa.RecordBatch:
    """Rows of ITEMS."""
    described = zip(*(describe(x, cuts) for x in data), strict=True) if data else [[]] * len(DESCRIBED)
    columns = [pa.array(list(c), kind) for c, kind in zip(described, DESCRIBED.values(), strict=True)]
    return pa.RecordBatch.from_arrays([keys, notes, pa.array(data, pa.binary()), *columns], ["key", "note", "data", *DESCRIBED])


def described_items(items: DataFrame, cuts: Callable[[bytes], list[int]]) -> DataFrame:
    """Rows of ITEMS for items(key long, note long, data binary); null data counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield item_batch(part.column(0), part.column(1), [x.as_py() for x in part.column(2)], cuts)

    return items.select("key", "note", F.coalesce("data", F.lit(b"")).alias("data")).mapInArrow(run, ITEMS)


def _exceptions(items: DataFrame, name: str) -> DataFrame:
    """(rid_, copy, omit, give): rows whose item another row holds, or that don't keep all chunks to themselves."""
    holders = materialize(items.groupBy("sha").agg(F.min("rid").alias("rid")).select("rid"), f"{name}-holders")
    copies = items.select("rid").join(holders, "rid", "left_anti")
    refs = items.select("rid", "digests").join(holders, "rid", "left_semi").select("rid", F.posexplode("digests").alias("place", "digest"))
    refs = materialize(refs, f"{name}-references")
    first = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "place")).alias("h"))
    first = materialize(first.select("h.rid", "h.place", "m"), f"{name}-chunks")
    omitted = refs.select("rid", "place").join(first, ["rid", "place"], "left_anti").withColumn("gives", F.lit(False))
    given = first.where("m > 1").select("rid", "place", F.lit(True).alias("gives"))
    places = lambda gives: F.collect_list(F.when(F.col("gives") == gives, F.col("place")))
    part = omitted.union(given).groupBy("rid").agg(places(False).alias("omit"), places(True).alias("give"))  # one item's chunks
    none = F.array().cast("array<int>")
    out = part.select(F.col("rid").alias("rid_"), F.lit(False).alias("copy"), "omit", "give").union(copies.select("rid", F.lit(True), none, none))
    out = materialize(out, f"{name}-exceptions")
    for scratch in (holders, refs, first):
        discard(scratch)
    return out


_GIVEN = pa.struct([("digest", pa.binary()), ("chunk", pa.binary())])


def _stored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Stored rows of items beside their exceptions. Chunks are slices of the data as it lies, null where omitted."""
    data, sizes, digests = batch.column("data").cast(pa.binary()), batch.column("sizes"), batch.column("digests")
    start = int(np.frombuffer(data.buffers()[1], np.int32)[data.offset])
    flat = sizes.flatten().to_numpy()
    ends = np.concatenate([[start], start + np.cumsum(flat)]).astype(np.int32)
    lists = np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy())]).astype(np.int32)
    here = np.ones(len(flat), bool)
    copy = batch.column("copy").fill_null(False)
    gives: list[list[dict[str, bytes]]] = [[]] * batch.num_rows
    for row in np.flatnonzero(batch.column("copy").is_valid().to_numpy(zero_copy_only=False)):
        at, n = int(lists[row]), int(lists[row + 1] - lists[row])
        if copy[row].as_py():
            here[at : at + n] = False
            continue
        omit, give = batch.column("omit")[row].as_py(), sorted(batch.column("give")[row].as_py())
        here[[at + i for i in omit + give]] = False
        own, value = digests[row].as_py(), data[row].as_py()
        gives[row] = [{"digest": own[i], "chunk": value[ends[at + i] - ends[at] : ends[at + i + 1] - ends[at]]} for i in give]
    valid = pa.py_buffer(np.packbits(here, bitorder="little").tobytes())
    chunks = pa.Array.from_buffers(pa.binary(), len(flat), [valid, pa.py_buffer(ends), data.buffers()[2]])
    own = pa.ListArray.from_arrays(lists, chunks)
    kept = [batch.column(c) for c in ("key", "note", *DESCRIBED)]
    return pa.RecordBatch.from_arrays([*kept, copy, own, pa.array(gives, pa.list_(_GIVEN))], ["key", "note", *DESCRIBED, "copy", "own", "given"])


def write_store(described: DataFrame, name: str, order: tuple[str, ...] = ()) -> Store:
    """Stores the items of `described` (ITEMS). With `order`, the files hold them in ascending order (nulls first) of
    these columns, then of row number. Keys may be null or repeat, and equal rows may."""
    spark = described.sparkSession
    items = materialize(described.withColumn("rid", F.monotonically_increasing_id()), f"{name}-items")
    except_ = _exceptions(items.select("rid", "sha", "digests"), name)
    bytes_ = except_.agg(F.sum(32 + 8 * (F.size("omit") + F.size("give")))).first()[0] or 0
    beside = items.join(F.broadcast(except_) if bytes_ <= BROADCAST_BYTES else except_, F.col("rid") == F.col("rid_"), "left")
    if order:  # after the join, which may shuffle
        by = [*(F.col(c).asc_nulls_first() for c in order), F.col("rid").asc()]
        beside = beside.repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _stored(batch.slice(at, 1024))

    path = new_path(spark, name)
    beside.select("key", "note", "data", *DESCRIBED, "copy", "omit", "give").mapInArrow(run, _ROW).write.option("compression", "zstd").parquet(path)
    discard(items)
    discard(except_)
    return Store(path, order)


def read_back(store: Store, spark: SparkSession, finish: Callable[[bytes, bytes], tuple], columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """(sha, *columns): finish(data, manifest) of each distinct stored item, rebuilt from its chunks and verified."""
    rows = store.rows(spark).where("NOT copy")
    lacks = F.exists("own", lambda c: c.isNull())
    given = rows.where(F.size("given") > 0).select(F.explode("given").alias("g")).select("g.digest", "g.chunk")
    refs = rows.where(lacks).select("sha", F.posexplode(F.arrays_zip("digests", "own")).alias("place", "z"))
    refs = refs.where("z.own IS NULL").select("sha", "place", F.col("z.digests").alias("digest"))
    filled = join_spread(refs, given, "digest").groupBy("sha").agg(F.collect_list(F.struct("place", "chunk")).alias("more"))  # one item's chunks
    kind = "array<struct<place: int, chunk: binary>>"
    names = ["size", "sha", "root", "digests", "sizes", "own"]
    whole = rows.where(~lacks).select(*names, F.array().cast(kind).alias("more"))
    part = rows.where(lacks).join(filled, "sha").select(*names, F.col("more").cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                here = batch.slice(at, 256)
                shas, found = here.column("sha").to_pylist(), []
                each = zip(shas, *(here.column(c).to_pylist() for c in ("size", "root", "digests", "sizes", "own", "more")), strict=True)
                for sha, size, root, digests, sizes, chunks, more in each:
                    for m in more:
                        chunks[m["place"]] = m["chunk"]
                    data = chunks[0] if len(chunks) == 1 else b"".join(chunks)
                    good = len(data) == size and [digest(c) for c in chunks] == digests and [len(c) for c in chunks] == sizes
                    if not (good and merkle_root(digests) == root and hashlib.sha256(data).digest() == sha):
                        raise ValueError("a stored item doesn't match its manifest")
                    found.append(finish(data, manifest(size, root, digests, sizes)))
                arrays = [pa.array([f[i] for f in found], t) for i, (_, _, t) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), *arrays], ["sha", *(c[0] for c in columns)])

    schema = "sha binary, " + ", ".join(f"{n} {t}" for n, t, _ in columns)
    return whole.union(part).mapInArrow(run, schema)
