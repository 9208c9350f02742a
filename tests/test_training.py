from __future__ import annotations

import math

import numpy as np
import pytest

from statelattice.operators import inference, kmeans, restarts, sampling, selection, training
from statelattice.operators.emissions import Discrete, Gaussian, NegativeBinomial, Poisson, Weibull, fit_column
from statelattice.operators.model import Hmm
from statelattice.operators.multivariate import DiagonalGaussian, FullCovarianceGaussian, IndependentComponents
from statelattice.operators.topology import Topology, enforce, initialize

# 107 yearly counts of large earthquakes, a public series used in many texts on hidden Markov models.
QUAKES = [
    13, 14, 8, 10, 16, 26, 32, 27, 18, 32, 36, 24, 22, 23, 22, 18, 25, 21, 21, 14, 8, 11, 14, 23, 18, 17, 19, 20, 22, 19, 13, 26, 13, 14, 22, 24, 21, 22, 26, 21, 23, 24, 27, 41, 31, 27,
    35, 26, 28, 36, 39, 21, 17, 22, 17, 19, 15, 34, 10, 15, 22, 18, 15, 20, 15, 22, 19, 16, 30, 27, 29, 23, 20, 16, 21, 21, 25, 16, 18, 15, 18, 14, 10, 15, 8, 15, 6, 11, 8, 7, 18, 16,
    13, 12, 13, 20, 15, 16, 12, 18, 15, 16, 13, 15, 16, 11, 11,
]
TRUE = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (Gaussian(0, 1), Gaussian(4, 2)))
START = Hmm((0.5, 0.5), ((0.5, 0.5), (0.5, 0.5)), (Gaussian(-1, 1), Gaussian(3, 1)))


@pytest.fixture(scope="module")
def sequences(spark):
    df = sampling.sample(spark, TRUE, 60, 40, seed=3).select("seq_id", "xs").cache()
    yield df
    df.unpersist()


def table(spark, sequences):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(sequences)], "seq_id long, xs array<double>")


def local_step(model, sequences):
    """Expectation-maximisation for Gaussians, path by path recurrences in probability space."""
    n = model.states
    initial, xi, gammas, xs, total = np.zeros(n), np.zeros((n, n)), [], [], 0.0
    a, pi = np.array(model.trans), np.array(model.pi)
    for s in sequences:
        b = np.exp(np.stack([e.logpdf(s) for e in model.emissions], 1))
        alpha, scale = np.zeros(b.shape), np.zeros(len(s))
        for t in range(len(s)):
            alpha[t] = (pi if t == 0 else alpha[t - 1] @ a) * b[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones(b.shape)
        for t in range(len(s) - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        g = alpha * beta
        initial += g[0]
        for t in range(len(s) - 1):
            xi += alpha[t][:, None] * a * (b[t + 1] * beta[t + 1])[None] / scale[t + 1]
        gammas.append(g)
        xs.append(np.asarray(s))
        total += np.log(scale).sum()
    g, x = np.concatenate(gammas), np.concatenate(xs)
    mu = (g * x[:, None]).sum(0) / g.sum(0)
    sd = np.sqrt((g * (x[:, None] - mu) ** 2).sum(0) / g.sum(0))
    return total, initial / initial.sum(), xi / xi.sum(1, keepdims=True), mu, sd


def test_step_equals_local_computation(spark, sequences):
    step = training.baum_welch_step(sequences, START)
    total, pi, trans, mu, sd = local_step(START, [np.array(r["xs"]) for r in sequences.collect()])
    assert step.logp == pytest.approx(total, rel=1e-12)
    np.testing.assert_allclose(step.model.pi, pi, atol=1e-10)
    np.testing.assert_allclose(step.model.trans, trans, atol=1e-10)
    np.testing.assert_allclose([e.mu for e in step.model.emissions], mu, atol=1e-9)
    np.testing.assert_allclose([e.sigma for e in step.model.emissions], sd, atol=1e-9)


def test_likelihood_rises_and_rows_stay_stochastic(sequences):
    done = training.baum_welch(sequences, START, 12)
    assert all(b >= a - 1e-9 for a, b in zip(done.history, done.history[1:], strict=False))
    np.testing.assert_allclose(np.array(done.model.trans).sum(1), 1, atol=1e-12)
    assert abs(done.model.emissions[0].mu) < 0.3 and abs(done.model.emissions[1].mu - 4) < 0.5


def test_earthquakes(spark):
    df = table(spark, [QUAKES]).cache()
    model = Hmm((0.5, 0.5), ((0.9, 0.1), (0.1, 0.9)), (Poisson(15), Poisson(25)))
    done = training.baum_welch(df, model, 23, tolerance=0)
    assert done.logp == pytest.approx(-341.878704, abs=2e-5)
    np.testing.assert_allclose([e.lambda_ for e in done.model.emissions], [15.41931, 26.01510], atol=5e-4)


def test_map_without_pseudo_counts_is_maximum_likelihood(sequences):
    a, b = training.baum_welch_step(sequences, START), training.baum_welch_step(sequences, START, 0.0)
    assert a == b
    smoothed = training.baum_welch_step(sequences, START, 1000.0).model
    assert abs(smoothed.trans[0][0] - 0.5) < abs(a.model.trans[0][0] - 0.5)
    for bad in (-1.0, math.nan):
        with pytest.raises(ValueError):
            training.baum_welch_step(sequences, START, bad)


def test_discrete_smoothing_and_prior(spark):
    model = Hmm((1.0,), ((1.0,),), (Discrete((0.5, 0.25, 0.25)),))
    df = table(spark, [[0, 0, 1]])
    new = training.baum_welch_step(df, model, 1.0).model
    np.testing.assert_allclose(new.emissions[0].probs, [3 / 6, 2 / 6, 1 / 6])
    assert training.log_prior(model, 2.0) == pytest.approx(2 * (math.log(0.5) + 2 * math.log(0.25)))
    assert training.log_prior(model, 0) == 0
    assert training.log_prior(Hmm((1.0, 0.0), ((1, 0), (0, 1)), model.emissions * 2), 1.0) == -math.inf


def test_impossible_sequences_are_skipped(spark):
    model = Hmm.uniform([Discrete((0.5, 0.5)), Discrete((0.9, 0.1))])
    good, both = table(spark, [[0, 1, 0]]), table(spark, [[0, 1, 0], [7, 7], []])
    assert training.baum_welch_step(good, model) == training.baum_welch_step(both, model)
    with pytest.raises(ValueError):
        training.baum_welch_step(table(spark, [[7, 7]]), model)
    with pytest.raises(ValueError):
        training.baum_welch_step(good, Hmm.blank(2, Discrete((0.5, 0.5))))


def test_single_observations_reset_transitions(spark):
    step = training.baum_welch_step(table(spark, [[1.0], [2.0]]), START)
    assert step.model.trans == ((0.5, 0.5), (0.5, 0.5))


def test_families_with_several_rounds(spark):
    model = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (Weibull(1.5, 1), NegativeBinomial(3, 0.4)))
    df = sampling.sample(spark, model, 30, 30, seed=4).select("seq_id", "xs").cache()
    done = training.baum_welch(df, model, 3)
    assert done.history[-1] >= done.history[0]


def test_viterbi_training(sequences):
    done = training.viterbi_training(sequences, START, training.FAST)
    assert done.converged
    np.testing.assert_allclose([e.mu for e in done.model.emissions], [0, 4], atol=0.5)
    with pytest.raises(ValueError):
        training.HardConfig(window=1)


def test_viterbi_step_counts(spark):
    model = Hmm((0.5, 0.5), ((0.5, 0.5), (0.5, 0.5)), (Gaussian(0, 1), Gaussian(10, 1)))
    step = training.viterbi_step(table(spark, [[0, 0, 10], [10, 10, 10]]), model)
    assert step.model.pi == (0.5, 0.5)
    assert step.model.trans == ((0.5, 0.5), (0.0, 1.0))
    assert step.model.emissions == (Gaussian(0, 1e-6), Gaussian(10, 1e-6))


def test_segmental_k_means(spark):
    done = training.segmental_k_means(table(spark, [[0.0, 0.1, 0.2, 5.0, 5.1, 5.3]]), Hmm.blank(2))
    assert done.converged and done.model.pi == (1.0, 0.0)
    assert done.model.emissions[0].mu == pytest.approx(0.1) and done.model.emissions[1].mu == pytest.approx(5.1333333)
    paths = training.even_paths(table(spark, [[1.0] * 3, [1.0] * 4, [], [1.0]]), 3)
    assert [r["path"] for r in paths.orderBy("seq_id").collect()] == [[0, 0, 0], [1, 1, 1, 2], [2]]


def test_topologies(sequences):
    assert initialize(Hmm.blank(3), Topology("left_to_right")).trans == ((1 / 3, 1 / 3, 1 / 3), (0.0, 0.5, 0.5), (0.0, 0.0, 1.0))
    assert initialize(Hmm.blank(3), Topology("banded", 1)).trans[0] == (0.5, 0.5, 0.0)
    model = Hmm((1.0, 0, 0), ((0, 0, 1), (0.5, 0.25, 0.25), (1, 0, 0)), (Gaussian(),) * 3)
    assert enforce(model, Topology("left_to_right_skip", 1)).trans == ((0.5, 0.5, 0.0), (0.0, 0.5, 0.5), (0.0, 0.0, 1.0))
    assert enforce(model, Topology()) is model
    with pytest.raises(ValueError):
        Topology("banded", 0)
    done = training.baum_welch(sequences, initialize(START, Topology("left_to_right")), 2, topology=Topology("left_to_right"))
    assert done.model.trans[1][0] == 0


def test_selection(sequences):
    assert selection.free_parameters(TRUE) == 2 + 1 + 4
    assert selection.aicc(-10, 3, 4) == math.inf
    c = selection.evaluate(sequences, TRUE)
    logp = inference.total_log_likelihood(inference.score(sequences, TRUE)).first()["logp"]
    assert c.aic == pytest.approx(14 - 2 * logp) and c.bic == pytest.approx(7 * math.log(2400) - 2 * logp)
    best = selection.compare(sequences, {"true": TRUE, "start": START}).orderBy("bic").first()
    assert best["model"] == "true"


def test_sampling_is_reproducible(spark):
    a, b = (sampling.sample(spark, TRUE, 300, 50, seed=9) for _ in range(2))
    assert a.orderBy("seq_id").collect() == b.repartition(3).orderBy("seq_id").collect()
    assert sampling.sample(spark, TRUE, 2, 0).first()["xs"] == []
    states = np.concatenate([r["states"] for r in a.collect()])
    assert abs((states == 0).mean() - 2 / 3) < 0.05
    with pytest.raises(ValueError):
        sampling.sample_local(Hmm((0, 0), ((1, 0), (0, 1)), TRUE.emissions), 3, np.random.default_rng(0))


def test_vectors(spark):
    model = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (DiagonalGaussian((0, 0), (1, 1)), FullCovarianceGaussian((5, 5), ((2, 0.5), (0.5, 1)))))
    df = sampling.sample(spark, model, 40, 30, seed=3).select("seq_id", "xs").cache()
    start = kmeans.kmeans_init(df, Hmm.uniform([FullCovarianceGaussian((0, 0), ((1, 0), (0, 1)))] * 2), seed=1)
    means = sorted(round(e.mean[0]) for e in start.emissions)
    assert means == [0, 5]
    done = training.baum_welch(df, start, 5)
    assert all(b >= a - 1e-6 for a, b in zip(done.history, done.history[1:], strict=False))
    assert done.model.emissions[0].n_params == 5


def test_kmeans_edges(spark):
    points = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],), ([9.0, 9.0],)], "x array<double>")
    centres = kmeans.lloyd(points, kmeans.seed_centres(points, 2, seed=4))
    assert sorted(map(tuple, centres)) == [(0.0, 0.5), (9.0, 9.0)]
    with pytest.raises(ValueError):
        kmeans.seed_centres(points, 4)


def test_best_of_n(spark, sequences):
    few = sequences.where("seq_id < 20").cache()
    one, two = (restarts.fit_best_of_n(few, START, n, seed=1, max_iterations=4) for n in (1, 2))
    assert two.logp >= one.logp
    with pytest.raises(ValueError):
        restarts.fit_best_of_n(few, START, 0)
    with pytest.raises(ValueError):
        restarts.fit_best_of_n(few.where("false"), START, 1)


def test_restarts_train_in_common_jobs(spark, monkeypatch):
    """The number of expectation jobs is that of the restart that takes longest, not the sum over restarts."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(3 * (i % 2), 1, 40)]) for i in range(8)], "seq_id long, xs array<double>").cache()
    model = Hmm((0.5, 0.5), ((0.9, 0.1), (0.1, 0.9)), (Gaussian(0.0, 1.0), Gaussian(1.0, 1.0)))
    alone = [training.baum_welch(df, m, 12) for m in (model, restarts.randomized(df, model, 5, 1), restarts.randomized(df, model, 5, 2))]
    jobs, reduce_ = [], training._reduce
    monkeypatch.setattr(training, "_reduce", lambda *a: jobs.append(len(a[1])) or reduce_(*a))
    best = restarts.fit_best_of_n(df, model, 3, seed=5, max_iterations=12)
    assert len(jobs) == max(len(t.history) for t in alone) and jobs[0] == 3
    found = [inference.total_log_likelihoods(df, {0: t.model})[0][1] for t in alone]
    assert best.logp == pytest.approx(max(found)) and best.reached_max_iterations == (not best.converged)


def test_vectors_of_other_sizes_are_refused(spark):
    for rows in ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0, 100.0]], [[1.0, 2.0], [3.0]]):
        df = spark.createDataFrame([(r,) for r in rows], "x array<double>")
        for start in (DiagonalGaussian((0, 0), (1, 1)), FullCovarianceGaussian((0, 0), ((1, 0), (0, 1))), IndependentComponents((Gaussian(), Gaussian()))):
            with pytest.raises(ValueError, match="vectors differ in size"):
                fit_column(df, start, "x")


def test_equal_points_count_in_seeding(spark):
    """A point that is held by nearly all rows is nearly always the first centre."""
    points = spark.createDataFrame([([0.0],)] * 300 + [([float(i)],) for i in range(1, 4)], "x array<double>")
    firsts = [kmeans.seed_centres(points, 1, seed=s)[0][0] for s in range(12)]
    assert firsts.count(0.0) >= 10
