from __future__ import annotations

import random

import numpy as np
import pytest

from statelattice.llm import near_dedup
from statelattice.llm.common import components
from statelattice.llm.near_dedup import near_duplicates
from statelattice.llm.shingles import shingle_set


def brute(texts, width, percent):
    """(n_shingles, component) of each position, by sets of word tuples and all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t\n", "one", "One", "two words", "a b c d", "a b c d e", "\x1c", "é è", "É è"]
    base = [word() for _ in range(90)]
    for n in range(90):  # a group of near copies, about the threshold
        copy = list(base)
        for _ in range(n % 5):
            copy[rng.randrange(90)] = word()
        out.append(" ".join(copy))
    out += [out[-1], out[-1].upper(), out[20]]
    for _ in range(60):  # a passage that makes up most of many documents
        out.append(" ".join(passage + [word() for _ in range(rng.randint(5, 60))]))
    for _ in range(60):
        out.append(" ".join(word() for _ in range(rng.randint(1, 300))))
    out.append(" ".join(word() for _ in range(5000)))
    out.append(out[-1] + " more")
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80), (3, 60)])
def test_equals_all_pairs(spark, width, percent):
    texts = corpus(width)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), width=width, percent=percent)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, (n, root) in enumerate(brute(texts, width, percent)):
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (n, root, root == i), texts[i]


def test_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    texts = corpus(7)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: root for i, (_, root) in enumerate(brute(texts, 4, 80))}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (None, "a b c d e f", 2, "y"), (3, None, 3, "z"), (4, "a b c d e f", 4, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cid long, sketch string")
    out = sorted(tuple(r) for r in near_duplicates(df).where("doc_id IS NOT NULL").collect())
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True), (4, 2, 1, False)]
    alone = near_duplicates(df).where("doc_id IS NULL").collect()
    assert [tuple(r) for r in alone] == [(None, 2, None, True)]
    assert near_duplicates(df.where("false")).count() == 0


def test_shared_ids(spark):
    """One id with several texts links them; the links of each of its texts count, and equal rows change nothing."""
    rng = random.Random(9)
    words = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    a, b, c = words(), words(), words()
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (9, c), (8, [*c, "z"]), (8, a[:20] + c[:20])] + [(11, [*c, "q", "r"])] * 3
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    for limit in (32, 1):
        near_dedup.SHORT, before = limit, near_dedup.SHORT
        try:
            found = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect())
        finally:
            near_dedup.SHORT = before
        assert found == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 8), (11, 8), (11, 8), (11, 8)]


@pytest.mark.parametrize("size", [52, 64, 80, 150, 600])
def test_sketches_find_pairs_at_the_threshold(size):
    """Of pairs at 0.8, whose sets are too large to be retained whole, the prefixes and the estimate lose none."""
    rng = np.random.default_rng(size)
    shared = near_dedup.least_shared(80)
    both = -(-8 * size // 9)  # of two sets of this size: 0.8 of their union at least
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
        a, b = np.sort(h[:size])[: near_dedup.K], np.sort(np.concatenate([h[:both], h[size:]]))[: near_dedup.K]
        union = np.unique(np.concatenate([a, b]))[: near_dedup.K]
        assert len(np.intersect1d(np.intersect1d(a, b), union)) >= min(shared, len(union) // 2)
        first = lambda x: x[::-1][: len(x) - shared + 1]  # any fixed order
        assert len(np.intersect1d(first(a), first(b)))
    assert (near_dedup.least_shared(80), near_dedup.least_shared(60)) == (32, 17)


def test_shingles():
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"", 4)) == len(shingle_set(None, 4)) == 0
    assert (shingle_set(b"A B c d E", 4) == shingle_set(b"a b\tC d\x0be", 4)).all()
    assert len(shingle_set(b"a a a a a a", 4)) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (101, 102), (5, 5), (200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 103)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
