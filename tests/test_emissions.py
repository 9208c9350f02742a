from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statelattice.functions import special
from statelattice.operators.emissions import (
    Beta,
    Binomial,
    ChiSquared,
    Discrete,
    Exponential,
    Gamma,
    Gaussian,
    LogNormal,
    NegativeBinomial,
    Pareto,
    Poisson,
    Rayleigh,
    StudentT,
    Uniform,
    VonMises,
    Weibull,
    families,
    fit_arrays,
    fit_column,
)

CASES = [
    Gaussian(2, 3), Exponential(2.5), Gamma(3, 2), LogNormal(1, 0.5), Beta(2, 5), Uniform(1, 4), Weibull(1.7, 3), Pareto(2.5, 1.5), Rayleigh(2), StudentT(5, 1, 2),
    ChiSquared(4), VonMises(1, 3), Discrete((0.1, 0.3, 0.6)), Poisson(4), Binomial(12, 0.3), NegativeBinomial(3.5, 0.4),
]
EDGES = [-3.0, -0.5, 0.0, 0.3, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 7.0, 12.0, 13.0, 1e9, math.inf, -math.inf, math.nan]


def test_registry_has_all_families():
    assert len(families()) >= 16 + 3 or len(families()) >= 16


@pytest.mark.parametrize("e", CASES, ids=lambda e: e.tag)
def test_columns_equal_arrays(spark, e):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(EDGES)], "i int, x double")
    got = [r["p"] for r in df.select("i", e.column("x").alias("p")).orderBy("i").collect()]
    want = e.logpdf(EDGES)
    assert None not in got
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("e", CASES, ids=lambda e: e.tag)
def test_density_sums_to_one(e):
    if e.discrete:
        total = np.exp(e.logpdf(np.arange(0, 400.0))).sum()
    else:
        x = np.linspace(-200, 400, 1_200_001) if e.tag not in ("VonMises",) else np.linspace(-math.pi, math.pi, 100_001)
        total = np.trapezoid(np.exp(e.logpdf(x)), x)
    assert total == pytest.approx(1, abs=3e-3)


@pytest.mark.parametrize("e", CASES, ids=lambda e: e.tag)
def test_cdf_is_the_integral(e):
    if e.discrete:
        for k in (0, 1, 2, 5):
            assert e.cdf(float(k)) == pytest.approx(min(1.0, np.exp(e.logpdf(np.arange(k + 1.0))).sum()), abs=1e-9)
    else:
        lo, hi = (0.4, 0.7) if e.tag == "Beta" else (1.6, 2.9)
        x = np.linspace(lo, hi, 20_001)
        assert e.cdf(hi) - e.cdf(lo) == pytest.approx(np.trapezoid(np.exp(e.logpdf(x)), x), abs=2e-5)


@pytest.mark.parametrize("e", CASES, ids=lambda e: e.tag)
def test_fit_recovers_and_equal_weights_change_nothing(e):
    x = e.sample(np.random.default_rng(1), 20_000)
    plain, weighted = e.reset(), e.reset()
    for _ in range(60 if e.tag == "StudentT" else 1):
        plain, weighted = fit_arrays(plain, x), fit_arrays(weighted, x, np.full(len(x), 0.37))
    if e.tag not in ("Binomial", "Uniform"):
        for k, v in e.params().items():
            np.testing.assert_allclose(plain.params()[k], v, rtol=0.08, atol=0.05)
    if e.tag != "Uniform":  # weighted: method of moments
        for k, v in plain.params().items():
            np.testing.assert_allclose(weighted.params()[k], v, rtol=2e-4)


@pytest.mark.parametrize("e", [Gaussian(), Gamma(), Weibull(), NegativeBinomial(), VonMises(), Pareto()], ids=lambda e: e.tag)
def test_spark_fit_equals_local_fit(spark, e):
    true = {c.tag: c for c in CASES}[e.tag]
    x = true.sample(np.random.default_rng(2), 500)
    w = np.random.default_rng(3).random(500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w, strict=True)], "x double, w double")
    for name, weights in (("w", w), (None, None)):
        got, want = fit_column(df, e, "x", name), fit_arrays(e, x, weights)
        for k, v in want.params().items():
            assert got.params()[k] == pytest.approx(v, rel=1e-8)


def test_boundary_rules():
    at = lambda e: (float(e.logpdf([0.0])[0]), float(e.point_logpdf([0.0])[0]))
    assert at(Gamma(0.5, 1)) == (-math.inf, math.inf)
    assert at(Gamma(1, 1)) == (-math.inf, -math.inf)
    assert at(ChiSquared(2)) == (-math.inf, math.log(0.5))
    assert at(ChiSquared(1)) == (-math.inf, math.inf)
    assert at(Weibull(1, 2)) == (-math.inf, -math.log(2))
    assert at(Beta(1, 3)) == (-math.inf, math.log(3))
    assert float(Beta(3, 1).point_logpdf([1.0])[0]) == pytest.approx(math.log(3))


def test_symbols_are_cut_counts_rounded_or_exact():
    assert Discrete((0.2, 0.8)).logpdf([1.9])[0] == pytest.approx(math.log(0.8))
    assert Discrete((0.2, 0.8)).logpdf([2.0])[0] == -math.inf
    assert Binomial(4, 0.5).logpdf([1.5])[0] == Binomial(4, 0.5).logpdf([2.0])[0]
    assert NegativeBinomial(2, 0.5).logpdf([2.5])[0] == NegativeBinomial(2, 0.5).logpdf([3.0])[0]
    assert Poisson(2).logpdf([1.5])[0] == -math.inf


@pytest.mark.parametrize("e", [Poisson(3), Weibull(2, 2), Gamma(2, 2), Gaussian(4, 2), StudentT(4, 1, 1), Uniform(0, 2), Rayleigh(3), VonMises(1, 1), Discrete((0.5, 0.5)), Exponential(3)], ids=lambda e: e.tag)
def test_no_weight_keeps_parameters(e):
    assert fit_arrays(e, [1.0, 2.0, 1.0], [0.0, 0.0, 0.0]) == e


def test_bad_observations_by_family():
    for e in (Poisson(), Weibull(), ChiSquared(), Beta()):
        with pytest.raises(ValueError):
            fit_arrays(e, [0.5, -1.0, 0.7])
    for e in (StudentT(), Uniform()):
        with pytest.raises(ValueError):
            fit_arrays(e, [0.5, math.inf, 0.7])
    assert fit_arrays(Exponential(3), [1.0, -1.0]) == Exponential()
    assert fit_arrays(Pareto(3, 2), [1.0, -1.0]) == Pareto()
    assert fit_arrays(Rayleigh(3), [1.0, 0.0]) == Rayleigh()
    assert fit_arrays(Gamma(3, 3), [1.0, 2.0, -5.0]) == fit_arrays(Gamma(3, 3), [1.0, 2.0])


def test_known_fits():
    assert fit_arrays(Gaussian(), [5.0]) == Gaussian()
    assert fit_arrays(LogNormal(), [math.e]) == LogNormal(1.0, 1e-6)
    assert fit_arrays(Binomial(), [0.0, 0.0]) == Binomial(1, 0.0)
    assert fit_arrays(NegativeBinomial(2, 0.2), [1.0, 1.0, 1.0]) == NegativeBinomial()
    assert fit_arrays(Uniform(), [1.0, 3.0]) == Uniform(0.9, 3.1)
    # out-of-support weight stays in the divisor
    assert fit_arrays(LogNormal(), [1.0, math.e**2, -1.0], [1.0, 1.0, 2.0]).mu == pytest.approx(0.5)
    assert fit_arrays(Rayleigh(), [2.0, -1.0], [1.0, 1.0]).sigma == pytest.approx(1.0)


@pytest.mark.parametrize("build", [lambda: Gaussian(0, 0), lambda: Gamma(-1, 1), lambda: Uniform(2, 1), lambda: VonMises(0, -1), lambda: NegativeBinomial(1, 0), lambda: Binomial(0, 0.5), lambda: Discrete(()), lambda: Beta(0, 1), lambda: StudentT(0, 0, 1)])
def test_parameters_are_checked(build):
    with pytest.raises(ValueError):
        build()


def test_special_functions():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert special.trigamma(0.5) == pytest.approx(math.pi**2 / 2, abs=1e-12)
    for x in (0.1, 0.5, 1.0, 3.3, 50.0, 1e5):
        assert special.lgamma(x) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    assert special.gamma_p(2, 3) == pytest.approx(1 - 4 * math.exp(-3), abs=1e-13)
    assert special.beta_i(0.3, 2, 1) == pytest.approx(0.09, abs=1e-13)
    assert special.erf(special.erf_inv(0.73)) == pytest.approx(0.73, abs=1e-13)
    assert special.bessel_i0(1) == pytest.approx(1.2660658777520084, rel=1e-13)
    assert special.bessel_i1(1) == pytest.approx(0.5651591039924851, rel=1e-13)
    assert special.log_i0(800) == pytest.approx(800 - 0.5 * math.log(2 * math.pi * 800) + math.log1p(1 / 6400), abs=1e-6)
    assert special.log_factorial(-1) == math.inf


def test_moments():
    assert StudentT(1, 3, 1).moments()["mean"] != StudentT(1, 3, 1).moments()["mean"]  # NaN
    assert StudentT(1.5, 3, 1).moments()["variance"] == math.inf
    assert Pareto(1, 2).moments()["mean"] == math.inf
    assert Discrete((0.5, 0.5)).moments()["entropy"] == pytest.approx(math.log(2))
    assert Gamma(3, 2).moments()["mode"] == 4


def test_null_observations_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert fit_column(df, Gaussian(), "x") == Gaussian(2.0, 1.0)
    assert df.select(Gaussian().column(F.col("x")).alias("p")).where("p IS NULL").count() == 0


@pytest.mark.parametrize("root", [1e-9, 0.003, 1.0, 77.7, 1e8])
@pytest.mark.parametrize("start", [1e-3, 1.0, 1e4])
def test_root_search(root, start):
    rounds = []

    def f(x):
        rounds.append(x)
        return math.log(x / root) * (1 + 0.3 * math.sin(x))

    assert special.solve(f, start, 1e-12, 1e12) == pytest.approx(root, rel=1e-10)
    assert len(rounds) < 150
    assert special.solve(lambda x: -1.0, 1.0, 1e-3, 1e3) == 1e3 and special.solve(lambda x: 1.0, 1.0, 1e-3, 1e3) == 1e-3
    assert special.solve(lambda x: math.nan, 2.0, 1e-3, 1e3) == 2.0
