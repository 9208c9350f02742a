"""Mixing sources to target weights, in DataFrame operations throughout.

The words of each source are laid end to end and packed into blocks of BLOCK words. The mix is a row of slots, dealt
into output shards of SHARD slots; a shard's counts by source are a multinomial draw. Where the draws of a source
come to more than its target needs, its last ones are handed to sources that fell short, so each total is exact. A
source's slots are numbered through the shards, and a keyed pseudorandom permutation of its block indices (another
one each time round) says which block a slot takes; the last slot of a source takes a part of its block. Blocks and
documents meet in an equi-join on (source, block index).

What is gathered has one row for each source (targets), or for each source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK, SHARD = 256, 4096
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, WALK = 4, 16


def _hashed(key: list[Column], i: int, by: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(i), by), n)


def _feistel(x: Column, a: Column, b: Column, key: list[Column], back: bool) -> Column:
    """One pass of an unbalanced Feistel network over 0 .. a*b - 1, or its inverse, as one expression."""
    left, right = F.pmod(x, a), F.floor(x / a).cast("long")
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2 == 0:
            step = _hashed(key, i, right, a)
            left = F.pmod(left - step if back else left + step, a)
        else:
            step = _hashed(key, i, left, b)
            right = F.pmod(right - step if back else right + step, b)
    return right * a + left


def with_permuted(rows: DataFrame, name: str, i: Column, n: Column, key: list[Column], back: bool = False) -> DataFrame:
    """rows with column `name`: the place of i in a keyed pseudorandom permutation of 0 .. n - 1 (back: the inverse).

    The network covers a*b >= n places with a = ceil(sqrt(n)); results from n on go round again. There are fewer
    than a such places, so WALK steps always end for n <= WALK**2; beyond, a walk that doesn't (a chance below
    WALK**-WALK) raises.
    The first two passes are projections, round by round; the few rows that need more go through a fold.
    """
    rows = rows.withColumns({"__x": i.cast("long"), "__n": n.cast("long")}).withColumn("__a", F.ceil(F.sqrt(F.col("__n").cast("double"))).cast("long"))
    rows = rows.withColumn("__b", F.ceil(F.col("__n") / F.col("__a")).cast("long"))
    x, a, b, left, right = (F.col(c) for c in ("__x", "__a", "__b", "__l", "__r"))
    for first in (True, False):
        rows = rows.withColumns({"__l": F.pmod(x, a), "__r": F.floor(x / a).cast("long")})
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            mine, other, base = ("__l", right, a) if r % 2 == 0 else ("__r", left, b)
            step = _hashed(key, r, other, base)
            rows = rows.withColumn(mine, F.pmod(F.col(mine) - step if back else F.col(mine) + step, base))
        turned = right * a + left
        rows = rows.withColumn("__x", turned if first else F.when(x < F.col("__n"), x).otherwise(turned))
    ended = lambda y: F.when(y < F.col("__n"), y).otherwise(F.raise_error(F.lit("a walk of the block permutation did not end")).cast("long"))
    on = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda y, _: F.when(y < F.col("__n"), y).otherwise(_feistel(y, a, b, key, back)), ended)
    return rows.withColumn(name, F.when(x < F.col("__n"), x).otherwise(on)).drop("__x", "__n", "__a", "__b", "__l", "__r")


def _targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) with sid and target: weights repeat over the sources by code point, null last; no
    target exceeds `most` times its source, and what that frees is shared by weight among the others."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # in ascending order of cap for each weight, the level if this and all later sources are free
    ladder = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(ladder), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ladder), F.lit(0.0))))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", F.max(F.when(free, F.col("level"))).over(everything))
    return rows.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))


def _needs(targets: DataFrame, seed: int) -> DataFrame:
    """targets with the slots that each source needs: `rounds` times all of its `blocks`, then `rest` words."""
    rows = targets.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long")).where("goal > 0")
    rows = rows.withColumn("rounds", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
    rows = rows.withColumn("rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
    rows = rows.withColumn("last_size", F.col("source_size") - (F.col("blocks") - 1) * BLOCK)
    rows = with_permuted(rows, "last_at", F.col("blocks") - 1, F.col("blocks"), [F.lit(seed), F.col("sid"), F.col("rounds")], back=True)
    some = F.ceil(F.col("rest") / BLOCK).cast("long")
    more = (F.col("last_at") < some) & (some * BLOCK - BLOCK + F.col("last_size") < F.col("rest"))
    return rows.withColumn("slots", F.col("rounds") * F.col("blocks") + some + more.cast("long"))


def draw_slots(needs: DataFrame, seed: int) -> DataFrame:
    """(shard, sid, nth): every output slot with its source and its number among the source's slots.

    needs(sid, slots). Each shard's slots draw their sources independently with probability slots / total, so its
    counts are multinomial; then surplus slots change hands until source totals are exact.
    """
    total = needs.agg(F.sum("slots")).first()[0] or 0
    ends = needs.select("sid", F.sum("slots").over(Window.orderBy("sid")).alias("end"))
    ladder = ends.agg(F.array_sort(F.collect_list(F.struct("end", "sid"))).alias("x")).scalar()  # one entry a source
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1)))
    ids = needs.sparkSession.range(total).select(F.floor(F.col("id") / SHARD).cast("long").alias("shard"), drawn.alias("at"), ladder.alias("ladder"))
    place = F.size(F.filter("ladder", lambda e: e["end"] <= F.col("at"))) + 1
    counts = ids.select("shard", F.element_at("ladder", place)["sid"].alias("sid")).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "mix-counts")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(needs.select("sid", "slots"), "sid").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first"))))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # a row becomes up to SHARD rows, so these few are dealt out first
    parts = int(needs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = counts.where("kept > 0").repartition(parts, "shard", "sid").select("shard", "sid", "first", upto(F.col("kept")).alias("i")).select("shard", "sid", (F.col("first") + F.col("i")).alias("nth"))
    spare = counts.where("n > kept").withColumn("spare", F.col("n") - F.col("kept"))
    spare = spare.withColumn("from", F.sum("spare").over(Window.orderBy("shard", "sid")) - F.col("spare"))  # few: the last shards of some sources
    spare = spare.select("shard", "from", upto(F.col("spare")).alias("i")).select("shard", (F.col("from") + F.col("i")).alias("place"))
    got = needs.select("sid", "slots").join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
    short = got.withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots").withColumn("short", F.col("slots") - F.col("got"))
    short = short.withColumn("from", F.sum("short").over(Window.orderBy("sid")) - F.col("short"))
    short = short.select("sid", "got", "from", upto(F.col("short")).alias("i")).select("sid", (F.col("got") + F.col("i")).alias("nth"), (F.col("from") + F.col("i")).alias("place"))
    return kept.union(spare.join(short, "place").select("shard", "sid", "nth"))


def take_blocks(slots: DataFrame, needs: DataFrame, seed: int) -> DataFrame:
    """(shard, sid, round, block, take): the block index of every slot and how many of its words, from its start, count."""
    rows = slots.join(needs.select("sid", "blocks", "rounds", "rest", "last_size", "last_at"), "sid")
    rows = rows.withColumn("round", F.floor(F.col("nth") / F.col("blocks")).cast("long")).withColumn("i", F.col("nth") - F.col("round") * F.col("blocks"))
    rows = with_permuted(rows, "block", F.col("i"), F.col("blocks"), [F.lit(seed), F.col("sid"), F.col("round")])
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_size")).otherwise(F.lit(BLOCK))
    before = F.col("i") * BLOCK - F.when(F.col("last_at") < F.col("i"), BLOCK - F.col("last_size")).otherwise(0)
    take = F.when(F.col("round") < F.col("rounds"), whole).otherwise(F.least(whole, F.col("rest") - before))
    return rows.select("shard", "sid", "round", "block", take.cast("long").alias("take"))


def _laid(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, size, tie) as (doc_id, source, size, tie, copies, start): documents end to end in their
    source. Equal rows are counted first, and a source is laid in buckets, so no task orders a whole source."""
    each = materialize(docs.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    buckets = max(64, each.count() // 50_000)
    each = each.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets))).withColumn("words", F.col("size") * F.col("copies"))
    sums = each.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    sums = materialize(sums.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), offset.alias("offset")), "mix-offsets")
    within = F.sum("words").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    rows = each.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return rows.select("doc_id", "source", "size", "tie", "copies", (F.col("offset") + F.col("within")).alias("start"))


#: One row of docs in the mix.
_MIXED = ["doc_id", "source", "tie", "size", "source_size", "target"]


def _drawn(docs: DataFrame, weights: list[float], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(*_MIXED, copies, sid, start, copy, round, from, to): the words from .. to - 1 of a row of docs that each slot takes, by
    the time round its source's blocks; a row of which a block isn't drawn has from = to there, or null."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"))
    laid = materialize(_laid(slim), "mix-laid")
    sizes = laid.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = materialize(_targets(sizes, weights, share, most), "mix-targets")
    needs = materialize(_needs(targets, seed), "mix-needs")
    takes = take_blocks(draw_slots(needs, seed), needs, seed).select("sid", "round", "block", "take")
    known = targets.select(F.col("source").alias("s_"), "sid", "source_size", "target")
    rows = laid.join(known, F.col("source").eqNullSafe(F.col("s_"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("start", F.col("start") + (F.col("copy") - 1) * F.col("size")).drop("s_")
    spans = F.sequence(F.floor(F.col("start") / BLOCK).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / BLOCK).cast("long"))
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, spans)))
    begin = F.col("block") * BLOCK
    first = F.greatest("start", begin) - F.col("start")
    end = F.greatest(first, F.least(F.col("start") + F.col("size"), begin + F.coalesce("take", F.lit(0))) - F.col("start"))
    return rows.join(takes, ["sid", "block"], "left").select(*_MIXED, "copies", "sid", "start", "copy", "round", first.alias("from"), end.alias("to"))


def mix_sources(
    docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row for each row of docs: doc_id, source, tie, size, source_size, target, taken.

    size is the number of words of the text (null: 0). Weights repeat over the sources in code point order, null
    being the last source; the targets share `share` times all words by weight, none above `most` (a whole number)
    times its source. taken counts the words of the document that the mix takes, repeats included: at most `most`
    times its size, and over a source its target to the nearest word. Reruns agree. Texts without words take nothing;
    null and repeated ids are allowed, and equal rows may take different parts. `tie` is a hash of the text. Other
    columns aren't read. An empty table gives an empty result.
    """
    drawn = _drawn(docs, weights, share, most, seed, id_col, text_col, source_col)
    mixed = drawn.groupBy(*_MIXED, "sid", "start", "copy").agg(F.coalesce(F.sum(F.col("to") - F.col("from")), F.lit(0)).cast("long").alias("taken"))
    return mixed.select(*_MIXED, "taken")


def mix_parts(
    docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, tie, size, copies, parts): what mix_sources counts, as the words themselves.

    parts has a struct (copy, round, from, to) for each longest run of words from .. to - 1 (counted from 0) that one
    time round the source's blocks takes from one of the `copies` equal rows. Rows of which nothing is taken go. Nulls,
    repeated rows, clashing columns and empty tables are as in mix_sources.
    """
    drawn = _drawn(docs, weights, share, most, seed, id_col, text_col, source_col).where(F.col("to") > F.col("from"))
    parts = F.array_sort(F.collect_list(F.struct("copy", "round", "from", "to")))
    rows = drawn.groupBy("doc_id", "source", "tie", "size", "copies").agg(parts.alias("all"))
    joined = lambda a, b: (a["copy"] == b["copy"]) & (a["round"] == b["round"]) & (a["to"] == b["from"])
    at = lambda i: F.get("all", i)
    heads = F.filter("all", lambda x, i: (i == 0) | ~F.coalesce(joined(at(i - 1), x), F.lit(False)))
    tails = F.filter("all", lambda x, i: ~F.coalesce(joined(x, at(i + 1)), F.lit(False)))
    runs = F.zip_with(heads, tails, lambda a, b: F.struct(a["copy"].alias("copy"), a["round"].alias("round"), a["from"].alias("from"), b["to"].alias("to")))
    return rows.select("doc_id", "source", "tie", "size", "copies", runs.alias("parts"))


def drawn_documents(docs: DataFrame, parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row of docs for each of the parts, with its words as the text and the white space before each; a part that
    is the whole document has the text as it is. parts: mix_parts(docs), materialised; of rows that are equal in id,
    source and text, one stands for all. Null texts and texts without words aren't drawn and go; no column name clashes,
    as long as none starts with two underscores; an empty table gives an empty result."""
    text = F.col(text_col).cast("string")
    keyed = parts.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("size").alias("__size"), F.col("copies").alias("__copies"), F.col("parts").alias("__parts"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    rows = docs.join(keyed, same & (F.xxhash64(text) == F.col("__tie")))
    if not parts.where("copies > 1").isEmpty():
        rows = rows.where("__copies = 1").union(rows.where("__copies > 1").dropDuplicates(["__id", "__source", "__tie"]))
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    cut = lambda w, p: F.array_join(F.slice(w, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), "")
    whole = lambda p: p["to"] - p["from"] == F.col("__size")
    # the outer transform holds the words of a text, so they are found once
    some = F.flatten(F.transform(F.array(words), lambda w: F.transform("__parts", lambda p: F.when(whole(p), text).otherwise(cut(w, p)))))
    texts = F.when(F.forall("__parts", whole), F.transform("__parts", lambda p: text)).otherwise(some)
    return rows.withColumn(text_col, F.explode(texts)).select(*docs.columns)
