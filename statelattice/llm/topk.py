"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into SEGMENTS of 16; an index lists the codes by (segment, value). A query first looks up all
values within radius START of each of its segments, then the radius grows by one in one segment after the other.
Once radius r has been reached in segments 0 .. a (and r - 1 in the others), every code up to distance
SEGMENTS * r + a has been met, and a query is done when its kth verified distance is no more than that.
Of a code's segments only the one nearest to the query's (the first of equals) reports it, so it is met once.

Vectors with equal codes share an index entry with their k smallest ids, and queries with equal codes one search:
answers are ordered by distance and id, so no other id of a code can appear.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEGMENTS, WIDTH = 4, 16
#: Radius up to which all segments are searched at once.
START = 2


def sign_code(vector: Column) -> Column:
    """64 bits: the signs (above zero or not) of the first 64 components; missing ones count as not above."""
    size = SEGMENTS * WIDTH
    bits = F.transform(F.slice(vector, 1, size), lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    bits = F.concat(bits, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), size - F.size(vector))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda code, bit: F.shiftleft(code, 1).bitwiseOR(bit))


def _segment(code: Column, i: int) -> Column:
    return F.shiftright(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _masks(radii: range) -> Column:
    """The segment values with as many bits set, as an array."""
    masks = [sum(1 << b for b in bits) for radius in radii for bits in combinations(range(WIDTH), radius)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")


def _best(rows: DataFrame, k: int, *key: str) -> DataFrame:
    """The k first of rows(*key, distance, id) for each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("distance", "id"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance) for queries(query_id, code): the k rows of codes(vec_id, code) that are
    nearest in Hamming distance, ties by smaller id, rank from 1; all rows where there are fewer than k.

    Rows with a null id or code take no part. Repeated rows count once. No rows on either side: an empty result.
    """
    rows = codes.where("vec_id IS NOT NULL AND code IS NOT NULL").select("code", F.col("vec_id").alias("id")).distinct()
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))  # Spark keeps k a code before it shuffles
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("code").agg(F.collect_list("id").alias("ids"))
    entries = materialize(entries, "codes")
    index = entries.select("code", "ids", F.posexplode(F.array(*(_segment(F.col("code"), i) for i in range(SEGMENTS)))).alias("segment", "value"))
    index = materialize(index, "code-index")
    asked = materialize(queries.where("query_id IS NOT NULL AND code IS NOT NULL").select("query_id", F.col("code").alias("asked")).distinct(), "queries")
    total = index.where("segment = 0").agg(F.sum(F.size("ids"))).first()[0] or 0
    far = SEGMENTS * WIDTH
    active = materialize(asked.select("asked").distinct().withColumn("bound", F.lit(far)), "active")
    best = materialize(active.select("asked", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("id")).where("false"), "best")
    steps = [(range(START + 1), list(range(SEGMENTS)))] + [(range(r, r + 1), [a]) for r in range(START + 1, WIDTH + 1) for a in range(SEGMENTS)]
    for radii, segments in steps:
        if active.isEmpty() or not total:
            break
        own = F.explode(F.array(*(F.struct(F.lit(a).alias("segment"), _segment(F.col("asked"), a).alias("own")) for a in segments))).alias("o")
        probes = active.select("asked", "bound", own).select("asked", "bound", "o.segment", "o.own", F.explode(_masks(radii)).alias("mask"))
        probes = probes.select("asked", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), F.bit_count("mask").alias("near"))
        # a planner would take the probes for as small as the queries, and broadcast them
        met = probes.hint("merge").join(index, ["segment", "value"])
        differ = F.col("asked").bitwiseXOR(F.col("code"))
        first = F.bit_count(differ) <= F.col("bound")
        for i in range(SEGMENTS):
            apart = F.bit_count(_segment(differ, i))
            first &= F.when(F.col("segment") > i, apart > F.col("near")).when(F.col("segment") < i, apart >= F.col("near")).otherwise(True)
        found = met.where(first).select("asked", F.bit_count(differ).alias("distance"), F.explode("ids").alias("id"))
        best = materialize(_best(best.select("asked", "distance", "id").union(found), k, "asked").drop("rank"), "best")
        covered = SEGMENTS * radii[-1] + segments[-1]
        reached = best.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")).withColumn("full", F.col("n") >= min(k, total))
        left = active.select("asked").join(reached, "asked", "left").where(~F.coalesce(F.col("full") & ((F.col("kth") <= covered) | F.lit(total <= k)), F.lit(False)))
        active = materialize(left.select("asked", F.when(F.col("full"), F.col("kth")).otherwise(F.lit(far)).alias("bound")), "active")
    ranked = _best(best, k, "asked").select("asked", "rank", F.col("id").alias("vec_id"), "distance")
    return asked.join(ranked, "asked").select("query_id", "rank", "vec_id", "distance")


def nearest_codes(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """hamming_top_k over the sign codes of all vectors, asked for each row whose id is divisible by `every` (itself
    among the answers). Null vectors have no code; other columns aren't read."""
    codes = vectors.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col)).alias("code"))
    codes = materialize(codes, "sign-codes")
    return hamming_top_k(codes, codes.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k)


# DuckDB: brute force over the same pairs.
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM v AS q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
