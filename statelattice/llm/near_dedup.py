"""MinHash near-duplicate detection with bottom-k sketches.

Plan. Each document's shingles are hashed with one hash function; its sketch is the K smallest values.
Documents with equal sets form one class, a node of the link graph. Inverted lists of retained values generate
candidates:

* a class is listed under the first values of its sketch only, rare values before frequent ones (any
  fixed order will do). Where the whole set is retained, two classes that reach the threshold must share
  one of these (prefix filter), so nothing is lost; for larger sets the prefix is sized for sketches that share
  least_shared() values, which a pair at the threshold misses with a chance below MISS;
* lists of up to SHORT classes are joined with themselves, pairs that differ too much in size are left out. Where
  both sets are retained whole their similarity is exact; else the union sketch (the K smallest values of both)
  estimates it, and pairs that share less than least_shared() of its values go. The rest is verified on full sets;
* longer lists (groups of near copies, passages that make up most of many documents) are compared in blocks of
  bounded size on full sets, each block returning a spanning forest of its links, never its pairs. First every
  block by itself; then, of each list, only the classes that those links have not joined to its largest component
  meet the others. Lists that overlap are merged first where that makes fewer comparisons.

Components come from distributed star contraction. No list, link or component is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, join_spread, lean, materialize, only_ids, scratch
from .shingles import shingle_set

#: Values that a sketch retains.
K = 64
#: Rows that are in the link graph.
TAKES_PART = "n > 0 AND doc_id IS NOT NULL"
#: Chance that a pair of large sets at the threshold isn't found.
MISS = 2e-8
#: Longest inverted list that is joined with itself; longer ones are compared in blocks.
SHORT = 32
#: Classes, and shingles, that a block holds at most (about).
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20


def least_shared(percent: int) -> int:
    """The most values that two sketches at the threshold share but for a chance of MISS: the K smallest values of the
    union are in both sets independently, each with a probability of percent / 100 at least."""
    p, below = percent / 100, 0.0
    for shared in range(K + 1):
        below += comb(K, shared) * p**shared * (1 - p) ** (K - shared)
        if below > MISS:
            return shared
    return K


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of docs(doc_id, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(x.as_py(), width) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([x[:K].astype(np.int64) for x in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "sketch"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, digest binary, sketch array<long>")


def _hashed(texts: DataFrame, width: int, kind: str) -> DataFrame:
    """(cid, digest, hs) of texts(cid, text binary): each whole set as sorted 64-bit integers, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x.as_py(), width) for x in part.column(1)]
                columns = [part.column(0), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "digest", "hs"])

    return texts.mapInArrow(lean(run), f"cid {kind}, digest binary, hs binary")


def _full_sets(docs: DataFrame, classes: DataFrame, again: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, hs), one row for each class in wanted(cid): its whole set, from a document that is in it.

    classes(cid, doc_id, digest); again(doc_id): the ids of more than one row of docs, whose texts may differ."""
    found = classes.select("cid", "doc_id", "digest").join(wanted, "cid", "left_semi")
    repeated = not again.isEmpty()
    once = found.join(again, "doc_id", "left_anti") if repeated else found
    once = materialize(once.select("doc_id", "cid"), "wanted")
    small = once.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(once) if small else once, "doc_id").select("cid", "text")
    sets = _hashed(texts, width, "long").select("cid", "hs")
    if repeated:  # those documents are hashed before it is known which of them is which class
        twice = materialize(found.join(again, "doc_id", "left_semi"), "wanted-again")
        own = _hashed(only_ids(docs, twice.select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("cid"), "text"), width, "long")
        sets = sets.union(own.select("digest", "hs").join(twice.select("digest", "cid"), "digest").select("cid", "hs").dropDuplicates(["cid"]))
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(lean(run), "a long, b long")


def _forest(percent: int):
    """Links within a block (side 0 alone), or between a block of side 0 and one of side 1, as a spanning forest."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block["hs"]]
        ids, side, n = block["cid"].to_numpy(), block["side"].to_numpy(), np.array([len(x) for x in sets])
        rows = np.repeat(np.arange(len(sets)), n)
        values, inverse, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        shared = counts[inverse] > 1
        rows, cols = rows[shared], column[inverse[shared]]
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(cols[-1]) + 1 if len(cols) else 0, 4096):
            lo, hi = np.searchsorted(cols, (start, start + 4096))
            wide = np.zeros((len(sets), 4096), np.float32)
            wide[rows[lo:hi], cols[lo:hi] - start] = 1
            both += wide @ wide.T
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        if side.any():
            linked &= side[:, None] != side[None, :]
        left, out = np.ones(len(ids), bool), []
        for seed in range(len(ids)):  # breadth first
            if left[seed]:
                left[seed], todo = False, [seed]
                while todo:
                    at = todo.pop()
                    near = np.flatnonzero(linked[at] & left)
                    left[near] = False
                    out += [(ids[at], ids[x]) for x in near]
                    todo += near.tolist()
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _grouped(lists: DataFrame) -> DataFrame:
    """(k, cid, nb, m) of lists(v, cid, n): the classes to compare with each other under a number k, in nb blocks.

    Lists that share classes are merged where their union takes fewer comparisons than all of them."""
    lows = materialize(lists.groupBy("v").agg(F.min("cid").alias("low")), "lows")  # small beside the lists: joined without dealing these by v
    merged = components(lists.join(lows, "v").select(F.col("cid").alias("a"), F.col("low").alias("b")), "lists")
    member = materialize(lists.join(merged.withColumnRenamed("node", "cid"), "cid").select("v", "cid", "n", "root"), "members")
    by_list = member.groupBy("root", "v").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    by_root = member.select("root", "cid", "n").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("rm"), F.sum("n").alias("rn"))
    cost = by_list.groupBy("root").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost")).join(by_root, "root")
    plan = by_list.join(cost, "root").withColumn("whole", F.col("rm").cast("double") * F.col("rm") <= F.col("cost"))
    pick = lambda a, b: F.when(F.col("whole"), F.col(a)).otherwise(F.col(b))
    blocks = F.greatest(F.ceil(pick("rm", "m") / BLOCK_ROWS), F.ceil(pick("rn", "n") / BLOCK_SHINGLES)).cast("int")
    # of two lists with one number (a collision) the classes are compared as well, which does no harm
    plan = plan.select("root", "v", F.xxhash64("whole", pick("root", "v")).alias("k"), blocks.alias("nb"), pick("rm", "m").alias("m"))
    return materialize(member.join(plan, ["root", "v"]).select("k", "cid", "nb", "m").distinct(), "groups")


def _long_lists(lists: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links among the classes of lists(v, cid, n, m), each list m long; `links` are known already."""
    group = _grouped(lists)
    sets = materialize(sets_of(group.select("cid").distinct()), "long-sets")
    block = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    own = group.select("k", "cid", block.alias("i"), F.lit(0).alias("side"))
    found = materialize(own.join(sets, "cid").groupBy("k", "i").applyInPandas(_forest(percent), "a long, b long"), "block-links")
    wide = group.where("nb > 1")
    if wide.isEmpty():
        return found
    joined = components(links.union(found), "joined").withColumnRenamed("node", "cid")
    wide = materialize(wide.join(joined, "cid", "left").withColumn("part", F.coalesce("root", "cid")).drop("root"), "wide-groups")
    parts = wide.groupBy("k", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("k").agg(F.max(F.struct("size", "part")).alias("x"), F.sum("size").alias("all"))
    largest = largest.select("k", F.col("x.part").alias("main"), (F.col("all") - F.col("x.size")).alias("left")).where("left > 0")
    open_ = materialize(join_spread(wide, largest, "k"), "open-groups").withColumn("no", F.ceil(F.col("left") * F.col("nb") / F.col("m")).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ones = open_.where(F.col("part") != F.col("main")).select("k", "cid", F.pmod(F.xxhash64("cid"), F.col("no")).cast("int").alias("j"), upto("nb").alias("i"), F.lit(0).alias("side"))
    others = open_.select("k", "cid", upto("no").alias("j"), block.alias("i"), F.lit(1).alias("side"))
    across = ones.unionByName(others).join(sets, "cid").groupBy("k", "i", "j").applyInPandas(_forest(percent), "a long, b long")
    return found.union(across.where("a <> b"))


def _shared_ids(rows: DataFrame, classes: DataFrame, again: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows(doc_id, digest) that share one of the ids in `again`."""
    own = materialize(rows.join(again, "doc_id", "left_semi").select("doc_id", "digest").distinct(), "repeated")
    own = materialize(own.join(classes.select("digest", "cid"), "digest").select("doc_id", "cid"), "repeated-classes")
    low = own.groupBy("doc_id").agg(F.min("cid").alias("b"))
    return join_spread(own, low, "doc_id").select(F.col("cid").alias("a"), "b").where("a <> b")


def _components(text: DataFrame, width: int, percent: int, kept: set[str]) -> tuple[DataFrame, DataFrame]:
    """Sketched rows of text(doc_id, text), and (digest, component_id) of those that take part; both are `kept`."""
    rows = materialize(_sketches(text, width).withColumn("rid", F.monotonically_increasing_id()), "sketches", kept)
    filled = rows.where(TAKES_PART)
    # a class goes by the number of a row of its least id
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("x")).select("digest", "x.doc_id", F.col("x.rid").alias("cid"))
    classes = materialize(classes, "classes")
    again = materialize(filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id"), "again")
    sketch = filled.select(F.col("rid").alias("cid"), "n", "sketch").join(classes.select("cid"), "cid", "left_semi")
    sketch = materialize(sketch, "class-sketches")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _full_sets(text, classes, again, wanted, width)

    retained = sketch.select("cid", F.explode("sketch").alias("v"))
    hot = materialize(retained.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHORT).select("v"), "frequent")
    hots = retained.join(hot, "v").groupBy("cid").agg(F.collect_set("v").alias("hots"))  # at most K each
    need, shared = F.ceil(F.col("n") * percent / 100), least_shared(percent)
    # partners of a set of up to K * percent / 100 are retained whole as well
    first = F.when(F.col("n") <= K * percent // 100, F.col("n") - need + 1).otherwise(F.greatest(F.lit(1), F.size("sketch") - shared + 1)).cast("int")
    hots_of = F.coalesce("hots", F.array().cast("array<long>"))
    ordered = F.concat(F.array_except("sketch", hots_of), F.array_intersect("sketch", hots_of))
    posts = sketch.join(hots, "cid", "left").select("cid", "n", F.explode(F.slice(ordered, F.lit(1), first)).alias("v"))
    lengths = posts.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = materialize(posts.join(lengths, "v"), "lists")

    short = lists.where(F.col("m") <= SHORT)
    a, b = short.select("v", F.col("cid").alias("a"), F.col("n").alias("na")), short.select("v", F.col("cid").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = a.join(b, "v").where(fits).select("a", "b", "na", "nb").distinct()
    sa, sb = sketch.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), sketch.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    exact = both * 100 >= (F.col("na") + F.col("nb") - both) * percent
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    near = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb"))) >= shared
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    judged = pairs.join(sa, "a").join(sb, "b").withColumn("whole", whole).where(F.when(F.col("whole"), exact).otherwise(near))
    likely = materialize(judged.select("a", "b", "whole"), "candidates")
    open_ = likely.where("NOT whole").select("a", "b")
    links = _verified(open_, sets_of(open_.select(F.explode(F.array("a", "b")).alias("cid")).distinct()), percent)
    links = materialize(links.union(likely.where("whole").select("a", "b")), "pair-links")
    if not again.isEmpty():
        links = links.union(_shared_ids(filled, classes, again))
    if not (long := lists.where(F.col("m") > SHORT)).isEmpty():
        links = links.union(_long_lists(long, links, sets_of, percent))
    roots = components(links, "links").select(F.col("node").alias("cid"), "root")
    named = classes.join(roots, "cid", "left").select("digest", "doc_id", F.coalesce("root", "cid").alias("root"))
    named = materialize(named, "class-roots")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = materialize(join_spread(named.select("digest", "root"), least, "root").select("digest", "component_id"), "class-components", kept)
    return rows, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id that links reach, and kept marks that document. A null or wordless text has an empty set
    and is linked with nothing. A row without an id is kept, has no component_id and takes no part. Repeated
    rows share a component. Rows that share an id but not a text are linked with each other. A very long text is
    hashed whole. Other columns, whatever their names, aren't read. An empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with scratch(docs.sparkSession) as kept:
        rows, found = _components(text, width, percent, kept)
    takes_part = F.expr(TAKES_PART)
    filled = rows.where(takes_part)
    joined = join_spread(filled.select("doc_id", "n", "digest", "rid"), found, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where(~takes_part).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
