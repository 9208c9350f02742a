"""Chat formatting after cumulative-snapshot collapse.

Loggers that write the whole conversation after every turn leave prefixes of longer conversations behind. Each turn
is hashed with its place; a rolling (prefix) hash stands for the conversation up to each turn. A conversation whose
full hash is another's prefix hash is a snapshot and goes by an anti-join; of equal conversations the least id stays.
Only the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns in a chunk; a conversation is numbered and hashed chunk by chunk, so a long one is no single task's.
CHUNK = 256


def _rolled(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, a, b) with place from 1 and prefix hashes ha, hb; a, b hash a turn's content."""
    rows = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1)).cast("long"))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    rows = rows.join(sizes, ["conv_id", "chunk"]).withColumn("place", F.col("offset") + F.row_number().over(order))
    rows = rows.select("conv_id", "chunk", "place", F.xxhash64("place", "a").alias("a"), F.xxhash64("b", "place").alias("b"))
    rows = materialize(rows, "turn-hashes")
    sums = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
    none = F.lit(0).cast("long")
    sums = sums.select("conv_id", "chunk", F.coalesce(F.bit_xor("ca").over(earlier), none).alias("ca"), F.coalesce(F.bit_xor("cb").over(earlier), none).alias("cb"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["conv_id", "chunk"])
    return rows.select("conv_id", "place", F.col("ca").bitwiseXOR(F.bit_xor("a").over(upto)).alias("ha"), F.col("cb").bitwiseXOR(F.bit_xor("b").over(upto)).alias("hb"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept) of turns(conv_id, turn, role, text).

    Turns are in ascending order (nulls first; ties by content), repeated rows count once, and null roles or texts
    are equal to each other only. Turns without conv_id belong to no conversation. Other columns aren't read.
    """
    hashed = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.xxhash64(F.lit(1), "role", F.col("text").isNull(), "text", F.col("role").isNull()).alias("a"), F.xxhash64(F.lit(2), F.col("text").isNull(), "text", "role", F.col("role").isNull()).alias("b")
    )
    rolled = materialize(_rolled(hashed.distinct()), "prefixes")
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("place", "ha", "hb")).alias("e")).select("conv_id", F.col("e.place").alias("place"), F.col("e.ha").alias("ha"), F.col("e.hb").alias("hb"))
    ends = materialize(ends, "conversations")
    key = ["place", "ha", "hb"]
    inner = rolled.join(ends.select("conv_id", F.col("place").alias("last")), "conv_id").where(F.col("place") < F.col("last")).select(*key).distinct()
    firsts = ends.groupBy(*key).agg(F.min("conv_id").alias("first")).join(inner, key, "left_anti")
    kept = firsts.select(F.col("first").alias("conv_id"), F.lit(True).alias("kept"))
    return ends.join(kept, "conv_id", "left").select("conv_id", F.col("place").alias("n_turns"), F.coalesce("kept", F.lit(False)).alias("kept"))


def chat_line(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, chat): the kept conversations of maximal_conversations(turns) as one string each."""
    own = turns.select("conv_id", "turn", "role", "text").distinct().join(conversations.where("kept").select("conv_id"), "conv_id", "left_semi")
    lines = own.select("conv_id", F.struct(F.col("turn"), F.xxhash64(F.lit(1), "role", F.col("text").isNull(), "text", F.col("role").isNull()).alias("a"), chat_line(F.col("role"), F.col("text")).alias("line")).alias("t"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "").alias("chat"))  # one output value


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, chat): one row for each conversation; chat is null for those that aren't kept."""
    found = materialize(maximal_conversations(turns), "maximal")
    return found.join(render(turns, found), "conv_id", "left").select("conv_id", "n_turns", "kept", "chat")


# DuckDB: prefixes as strings of content digests.
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS place, string_agg(md5(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))), '') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT conv_id, max(place) AS n_turns FROM p GROUP BY conv_id),
e AS (SELECT p.conv_id, n.n_turns, p.prefix FROM p JOIN n ON p.conv_id = n.conv_id AND p.place = n.n_turns),
i AS (SELECT DISTINCT p.prefix FROM p JOIN n ON p.conv_id = n.conv_id AND p.place < n.n_turns),
f AS (SELECT prefix, min(conv_id) AS first FROM e GROUP BY prefix),
k AS (SELECT e.conv_id, e.n_turns, e.conv_id = f.first AND i.prefix IS NULL AS kept
      FROM e JOIN f ON e.prefix = f.prefix LEFT JOIN i ON i.prefix = e.prefix),
c AS (SELECT conv_id, md5(string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chat_md5
      FROM t GROUP BY conv_id)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, k.kept, CASE WHEN k.kept THEN c.chat_md5 END AS chat_md5
FROM k JOIN c ON k.conv_id = c.conv_id
"""
