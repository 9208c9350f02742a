from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest

from statelattice.operators import inference, kernels, sampling
from statelattice.operators.emissions import Discrete, Gaussian, Poisson
from statelattice.operators.model import Hmm
from statelattice.operators.multivariate import DiagonalGaussian, FullCovarianceGaussian, IndependentComponents

CASINO = Hmm((0.75, 0.25), ((0.9, 0.1), (0.8, 0.2)), (Discrete((1 / 6,) * 6), Discrete((0.125,) * 5 + (0.375,))))
END = Hmm((0.5, 0.5), ((0.95, 0.05), (0.1, 0.9)), (Discrete((1 / 6,) * 6), Discrete((0.1,) * 5 + (0.5,))))


def table(spark, sequences, kind="array<double>"):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], f"seq_id long, xs {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("seq_id").collect()]


def brute(model, xs):
    """(log-likelihood, best log-probability, best path) over all paths."""
    b = np.stack([e.logpdf(np.asarray(xs, float)) for e in model.emissions], 1)
    scored = []
    for path in product(range(model.states), repeat=len(xs)):
        p = model.log_pi[path[0]] + b[0, path[0]]
        for t in range(1, len(xs)):
            p += model.log_trans[path[t - 1], path[t]] + b[t, path[t]]
        scored.append((p, path))
    best = max(p for p, _ in scored)
    return float(np.logaddexp.reduce([p for p, _ in scored])), best, next(path for p, path in scored if p == best)


GOLDEN = [[0.0, 1.0, 5.0, 4.0, 2.0], [3.0], [float(i % 6) for i in range(100)]]


@pytest.mark.parametrize("fold", [True, False])
def test_golden_likelihoods(spark, fold):
    df = table(spark, GOLDEN)
    np.testing.assert_allclose(column(inference.score(df, CASINO, fold), "logp"), [-8.984368792057, -1.856297990366, -179.549418758913], atol=1e-9)
    np.testing.assert_allclose(column(inference.viterbi_score(df, CASINO, fold), "logp"), [-9.667921481223, -2.079441541680, -189.894320045382], atol=1e-9)


def test_golden_paths(spark):
    df = table(spark, [[5.0] * 10])
    assert column(inference.viterbi(df, END), "path") == [[1] * 10]
    assert column(inference.posterior_decode(df, END), "path") == [[1] * 10]
    np.testing.assert_allclose(column(inference.score(df, END), "logp"), [-8.465953448463], atol=1e-9)


@pytest.mark.parametrize("states", [1, 2, 3])
def test_brute_force(spark, states):
    rng = np.random.default_rng(states)
    model = Hmm(tuple(rng.dirichlet([1] * states)), tuple(map(tuple, rng.dirichlet([1] * states, states))), tuple(Gaussian(float(i), 1 + i / 2) for i in range(states)))
    sequences = [rng.normal(1, 2, n).tolist() for n in (1, 2, 5, 7)]
    df = table(spark, sequences)
    want = [brute(model, s) for s in sequences]
    for fold in (True, False):
        np.testing.assert_allclose(column(inference.score(df, model, fold), "logp"), [w[0] for w in want], atol=1e-10)
    found = inference.viterbi(df, model)
    np.testing.assert_allclose(column(found, "logp"), [w[1] for w in want], atol=1e-10)
    assert column(found, "path") == [list(w[2]) for w in want]


def test_kernels_agree_with_folds_for_many_states(spark):
    for n in (4, 8, 16):
        rng = np.random.default_rng(n)
        model = Hmm(tuple(rng.dirichlet([1] * n)), tuple(map(tuple, rng.dirichlet([1] * n, n))), tuple(Gaussian(float(i), 1.0) for i in range(n)))
        df = table(spark, [rng.normal(n / 2, n / 2, t).tolist() for t in (3, 30)])
        np.testing.assert_allclose(column(inference.score(df, model, True), "logp"), column(inference.score(df, model, False), "logp"), rtol=1e-12)


def test_posteriors_sum_to_one_and_lattices_agree(spark):
    df = table(spark, GOLDEN)
    gamma = inference.lattice(df, CASINO, "posterior").groupBy("seq_id", "t").sum("value").collect()
    np.testing.assert_allclose([r["sum(value)"] for r in gamma], 1, atol=1e-10)
    a = {(r["t"], r["state"]): r["value"] for r in inference.lattice(df, CASINO, "forward").where("seq_id = 0").collect()}
    b = {(r["t"], r["state"]): r["value"] for r in inference.lattice(df, CASINO, "backward").where("seq_id = 0").collect()}
    for t in range(5):
        assert np.logaddexp.reduce([a[t, i] + b[t, i] for i in (0, 1)]) == pytest.approx(-8.984368792057, abs=1e-9)
    assert b[4, 0] == b[4, 1] == 0


def test_viterbi_never_exceeds_likelihood(spark):
    df = sampling.sample(spark, END, 50, 20, seed=1).select("seq_id", "xs")
    both = inference.score(df, END).alias("a").join(inference.viterbi_score(df, END).withColumnRenamed("logp", "best"), "seq_id")
    assert both.where("best > logp + 1e-9").count() == 0


def test_empty_null_and_impossible_sequences(spark):
    df = table(spark, [[], None, [9.0], [0.0, float("nan")], [1.0]])
    for fold in (True, False):
        scores = {r["seq_id"]: r["logp"] for r in inference.score(df, CASINO, fold).collect()}
        assert set(scores) == {2, 3, 4} and scores[2] == scores[3] == -math.inf and math.isfinite(scores[4])
    with pytest.raises(Exception, match="probability 0"):
        inference.posterior_decode(df, CASINO).collect()
    assert column(inference.posterior_decode(df, CASINO, "null"), "path") == [None, None, [0]]
    assert inference.lattice(df, CASINO, "posterior").select("seq_id").distinct().count() == 1
    assert inference.score(df.where("false"), CASINO).count() == 0
    assert [r["score"] for r in inference.normalized(inference.score(df, CASINO)).orderBy("seq_id").collect()][:2] == [-1e9, -1e9]


def test_null_inside_a_sequence_is_impossible(spark):
    df = table(spark, [[1.0, None, 2.0]])
    for fold in (True, False):
        assert column(inference.score(df, CASINO, fold), "logp") == [-math.inf]


def test_structural_zeros_and_ties(spark):
    model = Hmm((1.0, 0.0), ((0.5, 0.5), (0.0, 1.0)), (Gaussian(), Gaussian()))
    df = table(spark, [[0.0, 0.0, 0.0]])
    assert column(inference.viterbi(df, model), "path") == [[0, 1, 1]]
    same = Hmm((0.5, 0.5), ((0.5, 0.5), (0.5, 0.5)), (Gaussian(), Gaussian()))
    assert column(inference.viterbi(df, same), "path") == [[0, 0, 0]]
    assert column(inference.posterior_decode(df, same), "path") == [[0, 0, 0]]


def test_long_sequences_do_not_underflow(spark):
    model = Hmm((1.0,), ((1.0,),), (Discrete((0.25,) * 4),))
    df = table(spark, [[float(t % 4) for t in range(2000)]])
    for fold in (True, False):
        np.testing.assert_allclose(column(inference.score(df, model, fold), "logp"), [2000 * math.log(0.25)], atol=1e-6)


def test_chunked_scores_equal_plain_ones(spark):
    df = sampling.sample(spark, END, 20, 50, seed=2).select("seq_id", "xs")
    steps = df.selectExpr("seq_id", "posexplode(xs) AS (t, x)")
    plain = {r["seq_id"]: r["logp"] for r in inference.score(df, END).collect()}
    chunked = {r["seq_id"]: r["logp"] for r in inference.score_chunked(steps, END, chunk=7).collect()}
    assert set(plain) == set(chunked)
    for k, v in plain.items():
        assert chunked[k] == pytest.approx(v, abs=1e-9)


def test_uninitialised_model_is_rejected(spark):
    with pytest.raises(ValueError):
        inference.score(table(spark, [[1.0]]), Hmm.blank(2))


def test_totals_and_detection(spark):
    df = table(spark, [*GOLDEN, [9.0]])
    total = inference.total_log_likelihood(inference.score(df, CASINO)).first()
    assert total["logp"] == -math.inf and total["n_observations"] == 107
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, float(i), i < 3) for i in range(20)], "seq_id int, score double, bad boolean")
    found = inference.detection_table(rows, "bad").orderBy("k").collect()
    base = np.arange(3, 20)
    for r in found:
        cut = base.mean() - r["k"] * base.std()
        assert r["tp"] == sum(i < cut for i in range(3)) and r["fp"] == sum(i < cut for i in base)
    assert inference.effect_size(rows, "bad") == pytest.approx((base.mean() - 1) / math.sqrt((base.var() + np.arange(3).var()) / 2))
    assert rows.select(F.col("bad")).count() == 20


def test_vector_models(spark):
    rng = np.random.default_rng(5)
    sequences = [rng.normal(0, 1, (n, 2)).tolist() for n in (1, 4)]
    df = table(spark, sequences, "array<array<double>>")
    for e in (DiagonalGaussian((0, 1), (1, 2)), FullCovarianceGaussian((0, 1), ((2, 0.5), (0.5, 1))), IndependentComponents((Gaussian(), Gaussian(1, 2)))):
        model = Hmm((0.3, 0.7), ((0.6, 0.4), (0.1, 0.9)), (e, DiagonalGaussian((1, 1), (1, 1))))
        want = [brute(model, s)[0] for s in sequences]
        for fold in (True, False):
            np.testing.assert_allclose(column(inference.score(df, model, fold), "logp"), want, atol=1e-9)
    full = FullCovarianceGaussian((0, 0), ((2, 0.5), (0.5, 1)), 0.0)
    x = np.array([1.0, -1.0])
    cov = np.array([[2, 0.5], [0.5, 1]])
    assert full.logpdf(x) == pytest.approx(-math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * x @ np.linalg.inv(cov) @ x)
    assert full.logpdf([1.0, 2.0, 3.0]) == -math.inf
    ragged = table(spark, [[[1.0, 2.0], [1.0]]], "array<array<double>>")
    with pytest.raises(Exception, match="dimension"):
        inference.score(ragged, Hmm.uniform([full]), fold=False).collect()


def test_blocks_cover_every_sequence_once():
    lengths = np.random.default_rng(1).integers(1, 5000, 200)
    parts = list(kernels.blocks(lengths, 8))
    assert sorted(np.concatenate(parts).tolist()) == list(range(200))


def test_poisson_counts(spark):
    model = Hmm.uniform([Poisson(2), Poisson(9)])
    df = table(spark, [[1.0, 8.0, 2.0]])
    np.testing.assert_allclose(column(inference.score(df, model), "logp"), [brute(model, [1, 8, 2])[0]], atol=1e-10)
