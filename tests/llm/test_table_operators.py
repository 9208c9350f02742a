"""Sharding, mixing, top-k search and chat formatting."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statelattice.llm import chat, mixing, sharding, topk
from statelattice.llm.common import materialize

# -- sharding --------------------------------------------------------------------------------------------------


def shard_rows(n=600):
    rng = random.Random(4)
    return [(i, "é" * rng.randint(0, 60) if i % 7 else None) for i in range(n)] + [(3, "again")] * 50 + [(None, "no id"), (999, "x" * 4000)]


def test_shards_balance_and_places_have_no_gaps(spark):
    rows = shard_rows()
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    found = sharding.shard_by_bytes(df, 8).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    places, total = defaultdict(list), Counter()
    for r in found:
        places[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) == set(range(8))
    assert max(total.values()) - min(total.values()) <= 0.02 * sum(total.values())
    assert sharding.shard_by_bytes(df.where("false"), 8).count() == 0


def test_maps_are_edited_not_rebuilt(spark, tmp_path):
    load = {s: random.Random(s).randint(0, 50) for s in range(200)}
    one = sharding.first_map(7, 200)
    two = sharding.rebalance(one, load)
    sums = [sum(load[s] for s in range(200) if two.shard_of[s] == k) for k in range(7)]
    assert max(sums) - min(sums) <= 2
    changed = {s for s in range(200) if one.shard_of[s] != two.shard_of[s]}
    assert {e[0] for e in two.edits} == changed and len(changed) < 100
    three = sharding.grow(two, load)
    moved = [s for s in range(200) if two.shard_of[s] != three.shard_of[s]]
    assert moved and all(three.shard_of[s] == 7 for s in moved)
    assert sum(load[s] for s in moved) == pytest.approx(sum(load.values()) / 8, rel=0.2)
    for m in (one, two, three):
        sharding.save_map(spark, m, str(tmp_path / "map"))
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map")).collect()} == dict(enumerate(three.shard_of))
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()} == dict(enumerate(one.shard_of))
    assert sharding.rebalance(one, {}).edits == ()


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string")
    placed = sharding.shard_by_bytes(df, 3)
    sharding.write_shards(df, placed, str(tmp_path / "s"))
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert back == {r["doc_id"]: r["shard"] for r in placed.collect()}


# -- mixing ----------------------------------------------------------------------------------------------------


def mix_rows():
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)]
    return rows + [(7, "same row", "a")] * 30 + [(1000, None, "a"), (1001, "", "z"), (None, "no id here", "b"), (1002, "long " * 30_000, "c")]


def targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string").repartition(6)
    found = mixing.mix_sources(df, [3, 1, 2]).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets(dict(sizes), [3, 1, 2], 1.5, 2)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.51
    again = mixing.mix_sources(df.repartition(2), [3, 1, 2]).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema), [1]).count() == 0
    nothing = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema), [3, 1, 2]).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in nothing) == [(1, 0, 0.0), (2, 0, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 255, 1000])
def test_permutation(spark, n):
    rows = mixing.with_permuted(spark.range(n), "p", F.col("id"), F.lit(n), [F.lit(5)])
    rows = mixing.with_permuted(rows, "b", F.col("p"), F.lit(n), [F.lit(5)], back=True).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["b"] == r["id"] for r in rows)


def test_draws_are_multinomial_in_expectation_and_exact_in_total(spark):
    needs = spark.createDataFrame([(0, 9000), (1, 2000), (2, 1000), (3, 0)], "sid long, slots long")
    slots = mixing.draw_slots(needs, 3)
    counts = {(r["shard"], r["sid"]): r["count"] for r in slots.groupBy("shard", "sid").count().collect()}
    assert abs(counts[0, 0] - 0.75 * mixing.SHARD) < 5 * (0.1875 * mixing.SHARD) ** 0.5
    for sid, n in ((0, 9000), (1, 2000), (2, 1000)):
        assert sorted(r["nth"] for r in slots.where(F.col("sid") == sid).collect()) == list(range(n))


def test_drawn_documents_are_the_drawn_blocks(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 3, 200, 900, 3000]))), rng.choice(["a", "b", "b", None])) for i in range(120)]
    rows += [(None, "two equal rows " * 300, "a")] * 2 + [(5, "another text of an id", "b"), (190, " spaced  out\t", "c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string").repartition(3).cache()
    parts = materialize(mixing.mix_parts(df, [3, 1, 2], share=0.8), "test-parts")
    assert sum(p["from"] > 0 for r in parts.collect() for p in r["parts"]) > 5
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    found = mixing.drawn_documents(df, parts)
    assert found.columns == df.columns
    got = Counter((r["source"], w) for r in found.collect() for w in words(r["text"]))
    # each word of a source as often as the slots take its place
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    laid = mixing._laid(df.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie")))
    sizes = laid.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    needs = materialize(mixing._needs(mixing._targets(sizes, [3, 1, 2], 0.8, 2.0), 17), "test-needs")
    names = {r["sid"]: r["source"] for r in needs.collect()}
    times = Counter()
    for r in mixing.take_blocks(mixing.draw_slots(needs, 17), needs, 17).collect():
        times.update((names[r["sid"]], r["block"] * mixing.BLOCK + k) for k in range(r["take"]))
    texts = {(r["doc_id"], r["tie"]): words(r["text"]) for r in df.withColumn("tie", F.xxhash64("text")).collect()}
    want = Counter()
    for r in laid.collect():
        for k in range(r["size"] * r["copies"]):
            want[r["source"], texts[r["doc_id"], r["tie"]][k % r["size"]]] += times[r["source"], r["start"] + k]
    assert got == +want
    taken = Counter()
    for r in mixing.mix_sources(df, [3, 1, 2], share=0.8).collect():
        taken[r["source"]] += r["taken"]
    assert all(sum(n for (s, _), n in got.items() if s == source) == n for source, n in taken.items())


# -- top-k -----------------------------------------------------------------------------------------------------


def nearest(codes, asked, k):
    out = set()
    for q, c in asked:
        ranked = sorted({((c ^ d) & (2**64 - 1)).bit_count() << 32 | v for v, d in codes})[:k]
        out |= {(q, i + 1, r & 0xFFFFFFFF, r >> 32) for i, r in enumerate(ranked)}
    return out


@pytest.mark.parametrize("n", [3, 400])
def test_top_k_equals_brute_force(spark, n):
    rng = random.Random(n)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    hot = rng.getrandbits(64)
    codes = [(i, signed(hot if i % 4 == 0 else hot ^ (1 << rng.randrange(64)) if i % 4 == 1 else rng.getrandbits(64))) for i in range(n)]
    df = spark.createDataFrame([*codes, (None, 5), (n + 1, None), codes[0]], "vec_id long, code long")
    asked = [(i, c) for i, c in codes if i % 50 == 0]
    found = topk.hamming_top_k(df, spark.createDataFrame(asked, "query_id long, code long"), 5)
    assert {tuple(r) for r in found.collect()} == nearest(codes, asked, 5)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, code int")
    assert topk.nearest_codes(empty).count() == 0
    rows = [(0, [1.0] * 64, 1), (1, None, 1), (None, [1.0] * 64, 1), (2, [1.0] * 62 + [-1.0] * 2, 2), (100, [1.0] * 60, 3), (100, [1.0] * 60, 3)]
    found = topk.nearest_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int"), k=2).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["distance"]))
    assert by == {0: [(0, 0), (2, 2)], 100: [(100, 0), (2, 2)]}


# -- chats -----------------------------------------------------------------------------------------------------


def brute_chats(turns):
    own = defaultdict(list)
    for c, t, role, text in {x for x in turns if x[0] is not None}:
        own[c].append((t is not None, t or 0, role, text))
    seqs = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    kept = {}
    for c, s in seqs.items():
        inside = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        kept[c] = not inside and c == min(d for d, o in seqs.items() if o == s)
    return seqs, kept


def test_snapshots_collapse(spark):
    rng = random.Random(8)
    turns, n = [], 0
    for _ in range(25):
        talk = [(("user", "assistant")[t % 2], rng.choice(["hi", None, "ok", f"say {rng.random()}"])) for t in range(rng.randint(1, 9))]
        for end in {len(talk), rng.randint(1, len(talk)), 1}:
            turns += [(n, t, role, text) for t, (role, text) in enumerate(talk[:end])]
            n += 1
    turns += [(n, t, "user", f"turn {t}") for t in range(700)] + [(n + 1, t, "user", f"turn {t}") for t in range(300)]
    turns += [(None, 0, "user", "lost"), turns[0], (n + 2, None, None, None)]
    df = spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, place string").repartition(7)
    seqs, kept = brute_chats(turns)
    found = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert {c: (r["n_turns"], r["kept"]) for c, r in found.items()} == {c: (len(s), kept[c]) for c, s in seqs.items()}
    for c, s in seqs.items():
        want = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s)
        assert found[c]["chat"] == (want if kept[c] else None)
    assert chat.format_chats(df.where("false")).count() == 0


def test_stored_map_is_edited_and_grown(spark, tmp_path):
    path = str(tmp_path / "map")
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(2000)], "doc_id long, text string")
    place = lambda shards: {r["doc_id"]: r for r in sharding.shard_by_bytes(df, shards, slots=256, map_path=path).collect()}
    three = place(3)
    version = sharding.latest_map(spark, path).version
    assert {i: r["shard"] for i, r in place(3).items()} == {i: r["shard"] for i, r in three.items()}  # even already: no new version
    assert sharding.latest_map(spark, path).version == version
    four = place(4)
    now = sharding.latest_map(spark, path)
    assert now.shards == 4 and now.version > version
    held = {v: {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in range(1, now.version + 1)}
    assert all(len(m) == 256 for m in held.values())
    for rows, m in ((three, held[version]), (four, held[now.version])):  # records are where the map says
        assert all(m[r["virtual_slot"]] == r["shard"] for r in rows.values())
    grown = {s: b for s, b in held[version + 1].items() if b != held[version][s]}
    assert grown and set(grown.values()) == {3}  # growing moves slots to the new shard only
    with pytest.raises(ValueError, match="shards"):
        place(2)


def test_taken_equals_counting_words_by_hand(spark):
    """`taken` from the drawn blocks, word by word: blocks of each source by the order in which documents lie."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 3, 300, 900]))), rng.choice(["a", "b", None])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df, [3, 1, 2]).collect()}
    parts = mixing.mix_parts(df, [3, 1, 2]).cache()
    words = {i: t.split() for i, t, _ in rows}
    counted, seen = {i: 0 for i in words}, {}
    for r in mixing.drawn_documents(df, parts).collect():
        own = r["text"].split()
        counted[r["doc_id"]] += len(own)
        at = words[r["doc_id"]].index(own[0])
        assert words[r["doc_id"]][at : at + len(own)] == own  # a run of the document's words
        for w in own:
            seen[w] = seen.get(w, 0) + 1
    assert counted == taken and max(seen.values()) <= 2
    for source in ("a", "b", None):
        own = [r for r in mixing.mix_sources(df, [3, 1, 2]).collect() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
