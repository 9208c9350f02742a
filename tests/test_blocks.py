"""Packed blocks against the recurrences in log space."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from statelattice.operators import blocks, inference, kernels, kmeans, training
from statelattice.operators.emissions import Discrete, Gaussian
from statelattice.operators.model import Hmm
from statelattice.operators.topology import Topology, initialize

MODEL = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (Gaussian(0, 1), Gaussian(4, 2)))
FORWARD = initialize(MODEL, Topology("left_to_right"))
ONE = Hmm((1.0,), ((1.0,),), (Gaussian(1, 2),))
THREE = Hmm((0.2, 0.3, 0.5), ((0.5, 0.5, 0), (0.1, 0.6, 0.3), (0, 0, 1)), (Gaussian(0, 1), Gaussian(4, 2), Gaussian(0, 1)))


def ragged(seed=0, sizes=(7, 1, 30, 30, 2, 55)):
    rng = np.random.default_rng(seed)
    return [rng.normal(2, 3, n) for n in sizes]


def summed(parts):
    parts = list(parts)
    names = ("sequences", "logp", "initial", "transitions", "leaving", "occupancy")
    return [sum(getattr(p, n) for p in parts) for n in names] + [sum((p.gamma * p.xs).sum(1) for p in parts), sum(len(p.xs) for p in parts)]


def test_blocks_keep_sequences():
    own = ragged()
    b = blocks.block(own)
    for s, kept in zip(sorted(own, key=len, reverse=True), range(len(own)), strict=True):
        np.testing.assert_array_equal(b.sequence(kept), s)
        assert (b.owners() == kept).sum() == len(s)


@pytest.mark.parametrize("model", [ONE, MODEL, FORWARD, THREE])
@pytest.mark.parametrize("odd", [None, [math.nan, 1.0], [0.0, 1e200, 1.0], [60.0] * 40 + [-60.0] * 40])
def test_expectations_equal_those_in_log_space(model, odd):
    """Also where probabilities leave the range of doubles, and beside impossible sequences."""
    own = ragged() + ([] if odd is None else [np.array(odd)])
    for got, want in zip(summed(blocks.expected(model, blocks.block(own))), summed(blocks._in_log_space(model, own)), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-12)


def test_a_state_that_only_later_steps_need_is_not_lost():
    """The first state's share falls below the smallest double before the last step, which only it can emit."""
    model = Hmm((0.5, 0.5), ((1.0, 0.0), (0.0, 1.0)), (Discrete((1e-12, 1.0 - 2e-12, 1e-12)), Discrete((1.0, 0.0, 0.0))))
    own = [np.array([0.0] * 40 + [1.0])]
    (found,) = blocks.expected(model, blocks.block(own))
    assert found.occupancy == pytest.approx([41, 0]) and found.logp == pytest.approx(math.log(0.5) + 40 * math.log(1e-12), rel=1e-9)


@pytest.mark.parametrize("model", [ONE, MODEL, FORWARD, THREE])
def test_paths_equal_those_of_the_kernel(model):
    own = sorted([*ragged(1), np.array([math.nan, 2.0])], key=len, reverse=True)
    lengths = np.array([len(s) for s in own])
    logp, paths = kernels.viterbi(model, kernels.emissions(model, own), lengths)
    paths = [p[:n] for p, n, v in zip(paths, lengths, logp, strict=True) if v > -math.inf]
    found = blocks.assigned(model, blocks.block(own))
    assert found.logp == pytest.approx(logp[logp > -math.inf].sum()) and found.sequences == len(paths) == 6
    n = model.states
    np.testing.assert_array_equal(found.initial, np.bincount([p[0] for p in paths], minlength=n))
    moves = np.bincount(np.concatenate([p[:-1] * n + p[1:] for p in paths]), minlength=n * n)
    np.testing.assert_array_equal(found.moves, moves.reshape(n, n))
    np.testing.assert_array_equal(np.bincount(found.states, minlength=n), np.bincount(np.concatenate(paths), minlength=n))


def table(spark, sequences):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(sequences)], "seq_id long, xs array<double>")


def test_packing_keeps_all_steps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WORK", 64)  # many blocks, and sequences longer than one
    own = ragged(2, (5, 0, 90, 1, 33, 33, 12))
    rows = blocks.pack(table(spark, own), False, 2).collect()
    assert len(rows) > 3 and sum(len(r["xs"]) for r in rows) == 8 * sum(map(len, own))
    assert training.expectation(table(spark, own), MODEL).occupancy.sum() == pytest.approx(174)


def test_iterations_read_cached_blocks(spark, monkeypatch):
    """An iteration is one pass over the cached blocks and doesn't read the sequences again."""
    seen, of = [], training._totals
    monkeypatch.setattr(training, "_totals", lambda packed, *a: seen.append(packed.storageLevel.useMemory) or of(packed, *a))
    training.baum_welch(table(spark, ragged(3)).repartition(5), FORWARD, 3, tolerance=0, topology=Topology("left_to_right"))
    assert seen == [True] * 3
    seen.clear()
    training.viterbi_training(table(spark, ragged(3)), MODEL, training.FAST)
    assert len(seen) >= 2 and all(seen)


def test_an_iteration_has_as_many_tasks_as_cores_need(spark):
    """However many partitions the sequences have, most of them next to empty."""
    many = table(spark, ragged(4)).repartition(60)
    found = blocks.pack(many, False, 2).cache()
    assert found.rdd.getNumPartitions() <= blocks.TASKS * spark.sparkContext.defaultParallelism
    assert sum(len(r["xs"]) for r in found.collect()) == 8 * sum(map(len, ragged(4)))
    found.unpersist()


def test_vector_lists_are_read_at_once():
    column = pa.array([[[1.0, 2.0]], [[3.0, None], [5.0, 6.0]]], pa.list_(pa.list_(pa.float64())))
    one, two = inference._lists(column, True)
    np.testing.assert_array_equal(one, [[1, 2]])
    np.testing.assert_array_equal(two, [[3, math.nan], [5, 6]])
    with pytest.raises(ValueError, match="differ in dimension"):
        inference._lists(pa.array([[[1.0], [1.0, 2.0]]], column.type), True)


def test_rounds_of_kmeans_do_not_explode_points(spark, monkeypatch):
    """A round is one pass over cached blocks; sums come in one order, so centres come to a stand in all digits."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.1, 1, (300, 2)), rng.normal([4, 3], 1, (200, 2))])
    points = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(7)
    rounds, of = [], kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda packed, centres: rounds.append(packed.storageLevel.useMemory) or of(packed, centres))
    found = kmeans.lloyd(points, [[0.0, 0.0], [1.0, 1.0], [99.0, 99.0]])
    assert all(rounds) and len(rounds) < 60
    near = ((x[:, None] - np.array(found)[None]) ** 2).sum(2).argmin(1)
    assert found[2] == [99.0, 99.0]
    np.testing.assert_allclose(found[:2], [x[near == i].mean(0) for i in (0, 1)], rtol=1e-12)
