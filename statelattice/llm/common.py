"""What the corpus operators share: tables in the shared folder, size-checked lookups, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows up to which a one-column table of ids may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Rows of one key from which a join deals them out.
HOT_ROWS = 4096

#: Bytes of an Arrow batch, about, after small_batches().
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a temporary one in local mode (tests), an error on a
    cluster, whose machines don't share local folders."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(context.applicationId, tempfile.mkdtemp(prefix="statelattice-"))


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/statelattice/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators have written to the shared folder. For when their results
    have been written elsewhere: results that are still to be evaluated read these tables."""
    _delete(spark, _own_tables(spark))


_made: ContextVar[list[str] | None] = ContextVar("tables of the operator that is running", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes the tables that materialize() writes within, but for the folders in the set that this gives."""
    before, made, kept = _made.get(), [], set()
    mark = _made.set(made)
    try:
        yield kept
    finally:
        _made.reset(mark)
        for folder in made:
            if folder not in kept:
                _delete(spark, folder)
            elif before is not None:
                before.append(folder)


def materialize(df: DataFrame, name: str, kept: set[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors. With `kept`, the
    table outlives the scratch() that this set is from."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    if kept is not None:
        kept.add(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table of materialize() of which nothing is read any more, whatever is still unevaluated."""
    if files := table.inputFiles():
        _delete(table.sparkSession, files[0].rsplit("/", 1)[0])


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left inner join right on `key`, of which right has no two rows alike.

    A key with more than a ten-thousandth of left's rows (and HOT_ROWS at least) is dealt into parts, and its one row
    of right is repeated for each of them, so no task gets all rows of a frequent key (left's rows must differ in other
    columns to be dealt apart). There are 10,000 such keys at most, so that table is broadcast."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot_rows = max(HOT_ROWS, left.count() // 10_000)
    hot = materialize(counts.where(F.col("__n") > hot_rows).select(key, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key)
    part = F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), F.col("__parts")).cast("int")  # the same if a task runs again
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(part, F.lit(0))).drop("__parts")
    parts = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    return dealt.join(right.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(parts)).drop("__parts"), [key, "__part"]).drop("__part")


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` is in the one-column table `ids`; broadcast only after a count of it."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, column, "left_semi")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in edges(a, b): root is the smallest node of its connected component.

    Alternates large-star and small-star steps until the edges no longer change; every step is an
    aggregate and a join, so no component is ever gathered in one task.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where("u <> v").distinct(), name)
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold BATCH_BYTES or little more, or less where it says so already.

    A batch of 10,000 texts or 64 MB, Spark's limits, is held by the JVM outside of its heap, where its buffer doubles
    as it grows, and by the Python worker, once for each task of an executor."""
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_LIMIT))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's and C's allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in workers that hold no more between tasks than they use. Spark keeps its Python workers from
    stage to stage, each beside the JVM's heap; what the task before has left is freed only when the next one begins."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def map_texts(df: DataFrame, text_col: str, new: dict[str, tuple[DataType, pa.DataType]], of: Callable[[str | None], tuple[Any, ...]]) -> DataFrame:
    """df with the columns `new`, computed from one text at a time; a column of the same name is replaced in place.

    Rows pass through Python in small slices of their Arrow batches, so a worker holds few texts at once.
    """
    kept = [f for f in df.schema.fields if f.name not in new or f.name == text_col]
    order = [*kept, *(StructField(n, t[0]) for n, t in new.items() if n != text_col)]
    places = [df.columns.index(f.name) for f in kept]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                rows = [of(x.as_py()) for x in part.column(at)]
                made = {n: pa.array([r[i] for r in rows], t[1]) for i, (n, t) in enumerate(new.items())}
                columns = [made[text_col] if p == at and text_col in made else part.column(p) for p in places]
                yield pa.RecordBatch.from_arrays([*columns, *(made[n] for n in made if n != text_col)], [f.name for f in order])

    return df.mapInArrow(lean(run), StructType(order))
