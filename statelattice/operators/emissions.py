"""Scalar emission families.

A family is an immutable set of parameters with three forms that share one definition: its log-density (a Catalyst
expression or a NumPy one, see functions.algebra), the statistics that a fit needs (aggregates, so Spark combines
them map-side), and the driver-side solution. A fit is a coroutine: it yields the statistics it wants, is sent their
values, and returns the fitted emission; most ask once, Weibull and negative binomial once per round of a root search,
for several candidates at a time.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Generator
from dataclasses import dataclass, fields
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.algebra import Arrays, Columns
from ..functions.special import INF, ZERO, digamma, solve, trigamma

#: A statistic: how values combine ("sum", "min" or "max") and the value of an observation x of weight w.
Stat = tuple[str, Callable[[Any, Any, Any], Any]]
Fit = Generator[dict[str, Stat], dict[str, float], "Emission"]

_REGISTRY: dict[str, type[Emission]] = {}


def register_emission(family: type[Emission]) -> type[Emission]:
    """Makes a family known by its tag: to model files, queries and trainers. Usable as a decorator."""
    _REGISTRY[family.tag] = family
    return family


def family(tag: str) -> type[Emission]:
    if tag not in _REGISTRY:
        raise ValueError(f"unknown emission family {tag!r}")
    return _REGISTRY[tag]


def families() -> list[str]:
    return sorted(_REGISTRY)


def _positive(*values: float) -> bool:
    return all(math.isfinite(v) and v > 0 for v in values)


@dataclass(frozen=True)
class Emission:
    """What every family offers; subclasses are frozen dataclasses of their parameters."""

    tag: ClassVar[str]
    multivariate: ClassVar[bool] = False
    discrete: ClassVar[bool] = False

    @property
    def dim(self) -> int:
        return 1

    def __post_init__(self) -> None:
        if not self.valid():
            raise ValueError(f"{self.tag}: parameters out of range: {self.params()}")

    def valid(self) -> bool:
        return True

    def params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def replace(self, **changes: Any) -> Emission:
        return dataclasses.replace(self, **changes)

    def reset(self) -> Emission:
        return type(self)()

    @property
    def n_params(self) -> int:
        return len(fields(self))

    # densities: `log_density` is the rule of inference; `point_log_density` differs at a few boundaries
    def log_density(self, o: Any, x: Any) -> Any:
        raise NotImplementedError

    def point_log_density(self, o: Any, x: Any) -> Any:
        return self.log_density(o, x)

    def column(self, x: Column | str) -> Column:
        return self.log_density(Columns, F.col(x) if isinstance(x, str) else x)

    def logpdf(self, x: Any) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(self.log_density(Arrays, np.asarray(x, float)) + np.zeros(np.shape(x)))

    def point_logpdf(self, x: Any) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(self.point_log_density(Arrays, np.asarray(x, float)) + np.zeros(np.shape(x)))

    def pdf(self, x: Any) -> np.ndarray:
        return np.exp(self.point_logpdf(x))

    def cdf(self, x: Any) -> np.ndarray:
        raise NotImplementedError

    def cdf_column(self, x: Column) -> Column | None:
        """The distribution function as an expression, for the families that have one in closed form."""
        return None

    def moments(self) -> dict[str, float]:
        """mean, variance, sd and what else the family defines."""
        mean, variance, more = self._moments()
        return {"mean": mean, "variance": variance, "sd": math.sqrt(variance) if variance == variance and variance >= 0 else math.nan} | more

    def _moments(self) -> tuple[float, float, dict[str, float]]:
        raise NotImplementedError

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        raise NotImplementedError

    def fitting(self, weighted: bool) -> Fit:
        """The fit as a coroutine. Unweighted fits see w = 1."""
        raise NotImplementedError
        yield

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.tag} | self.params()

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Emission:
        names = [f.name for f in fields(cls)]
        if [k for k in values if k != "type"] != names:
            raise ValueError(f"{cls.tag}: expected {names} in this order, got {list(values)}")
        return cls(**{k: values[k] for k in names})


# -- running fits ----------------------------------------------------------------------------------------------


def _sum(value: Callable[[Any, Any, Any], Any]) -> Stat:
    return "sum", value


def _weigh(test: Callable[[Any, Any], Any], value: Callable[[Any, Any], Any] | None = None) -> Stat:
    """Sum of w * value(x) over observations of positive weight that pass the test."""
    return "sum", lambda o, x, w: o.where(test(o, x) & (w > 0), w * (value(o, x) if value else 1.0), 0.0)


TOTAL: Stat = _sum(lambda o, x, w: w)
COUNT: Stat = _sum(lambda o, x, w: o.where(w == w, 1.0, 1.0))


def columns_of(stats: dict[str, Stat], x: Column, w: Column, prefix: str = "", where: Column | None = None) -> list[Column]:
    """Aggregates of a request, named with prefix."""
    out = []
    for name, (how, value) in stats.items():
        each = value(Columns, x, w)
        each = each if where is None else F.when(where, each)
        combined = {"sum": lambda e: F.coalesce(F.sum(e), F.lit(0.0)), "min": lambda e: F.coalesce(F.min(e), F.lit(INF)), "max": lambda e: F.coalesce(F.max(e), F.lit(-INF))}[how](each)
        out.append(combined.alias(prefix + name))
    return out


def of_arrays(stats: dict[str, Stat], x: np.ndarray, w: np.ndarray) -> dict[str, float]:
    out = {}
    with np.errstate(all="ignore"):
        for name, (how, value) in stats.items():
            each = np.broadcast_to(value(Arrays, x, w), w.shape)
            out[name] = float({"sum": np.sum, "min": lambda e: e.min(initial=INF), "max": lambda e: e.max(initial=-INF)}[how](each))
    return out


def fit_arrays(start: Emission, x: Any, w: Any = None) -> Emission:
    """A fit on local arrays."""
    x = np.asarray(x, float)
    fit = start.fitting(w is not None)
    weights = np.ones(len(x)) if w is None else np.asarray(w, float)
    try:
        want = next(fit)
        while True:
            want = fit.send(of_arrays(want, x, weights))
    except StopIteration as end:
        return end.value


def fit_many(starts: dict[Any, Emission], answer: Callable[[dict[Any, dict[str, Stat]]], dict[Any, dict[str, float]]], weighted: bool) -> dict[Any, Emission]:
    """Runs several fits side by side: each round, `answer` gets all open requests at once (one Spark job)."""
    fits = {k: e.fitting(weighted) for k, e in starts.items()}
    done: dict[Any, Emission] = {}
    wants: dict[Any, dict[str, Stat]] = {}
    for k, fit in fits.items():
        try:
            wants[k] = next(fit)
        except StopIteration as end:
            done[k] = end.value
    while wants:
        got = answer(wants)
        again = {}
        for k in wants:
            try:
                again[k] = fits[k].send(got[k])
            except StopIteration as end:
                done[k] = end.value
        wants = again
    return {k: done[k] for k in starts}


def fit_column(df: DataFrame, start: Emission, x: str, w: str | None = None) -> Emission:
    """A fit on a column: one aggregate per round, of a few sums. NULL observations are left out."""

    def answer(wants: dict[Any, dict[str, Stat]]) -> dict[Any, dict[str, float]]:
        rows = df.where(F.col(x).isNotNull())
        weight = F.lit(1.0) if w is None else F.col(w)
        value = F.col(x) if start.multivariate else F.col(x).cast("double")
        return {k: rows.agg(*columns_of(want, value, weight)).first().asDict() for k, want in wants.items()}

    return fit_many({0: start}, answer, w is not None)[0]


def fit_groups(df: DataFrame, starts: dict[int, Emission], group: str, x: str, w: dict[int, str] | None = None) -> dict[int, Emission]:
    """A fit for each group (or each weight column) in common aggregates."""

    def answer(wants: dict[Any, dict[str, Stat]]) -> dict[Any, dict[str, float]]:
        aggregates = []
        for k, want in wants.items():
            weight, here = (F.col(w[k]), None) if w else (F.lit(1.0), F.col(group) == k)
            value = F.col(x) if starts[k].multivariate else F.col(x).cast("double")
            aggregates += columns_of(want, value, weight, f"{k}__", here)
        row = df.where(F.col(x).isNotNull()).agg(*aggregates).first().asDict()
        return {k: {name: row[f"{k}__{name}"] for name in want} for k, want in wants.items()}

    return fit_many(starts, answer, w is not None)


# -- families --------------------------------------------------------------------------------------------------

_finite = lambda o, x: o.finite(x)
_above = lambda o, x: o.finite(x) & (x > 0)


@register_emission
@dataclass(frozen=True)
class Gaussian(Emission):
    tag: ClassVar[str] = "Gaussian"
    mu: float = 0.0
    sigma: float = 1.0

    def valid(self) -> bool:
        return math.isfinite(self.mu) and _positive(self.sigma)

    def log_density(self, o, x):
        z = (x - self.mu) / self.sigma
        return o.where(o.finite(x), -0.5 * z * z - (0.5 * math.log(2 * math.pi) + math.log(self.sigma)), o.never)

    def cdf(self, x):
        return 0.5 * (1 + special.erf((np.asarray(x, float) - self.mu) / (self.sigma * math.sqrt(2))))

    def _moments(self):
        return self.mu, self.sigma**2, {}

    def sample(self, rng, n):
        return rng.normal(self.mu, self.sigma, n)

    def fitting(self, weighted):
        c = self.mu  # sums about the present mean lose fewer digits
        s = yield {"n": COUNT, "w": TOTAL, "d": _weigh(_finite, lambda o, x: x - c), "dd": _weigh(_finite, lambda o, x: (x - c) * (x - c))}
        if not weighted and s["n"] <= 1:
            return self.reset()
        if not s["w"] >= ZERO:
            return self
        d = s["d"] / s["w"]
        sd = math.sqrt(max(0.0, s["dd"] / s["w"] - d * d))
        return Gaussian(c + d, max(sd, special.MIN_SD))


@register_emission
@dataclass(frozen=True)
class Exponential(Emission):
    tag: ClassVar[str] = "Exponential"
    lambda_: float = 1.0

    def valid(self) -> bool:
        return _positive(self.lambda_)

    def params(self):
        return {"lambda": self.lambda_}

    @classmethod
    def from_dict(cls, values):
        return _from_lambda(cls, values, ["lambda"])

    def log_density(self, o, x):
        return o.where(o.finite(x) & (x >= 0), math.log(self.lambda_) - self.lambda_ * x, o.never)

    def cdf(self, x):
        return -np.expm1(-self.lambda_ * np.maximum(np.asarray(x, float), 0))

    def cdf_column(self, x):
        return -F.expm1(-self.lambda_ * F.greatest(x, F.lit(0.0)))

    def _moments(self):
        return 1 / self.lambda_, 1 / self.lambda_**2, {}

    def sample(self, rng, n):
        return rng.exponential(1 / self.lambda_, n)

    def fitting(self, weighted):
        bad = _sum(lambda o, x, w: o.where(o.finite(x) & (x >= 0), 0.0, 1.0))
        s = yield {"n": COUNT, "bad": bad, "w": TOTAL, "x": _weigh(_finite, lambda o, x: x)}
        if not weighted and (s["n"] <= 1 or s["bad"]):
            return self.reset()
        if not s["w"] >= ZERO:
            return self
        mean = s["x"] / s["w"]
        return Exponential(1 / mean) if mean > 0 and _positive(1 / mean) else self.reset()


def _from_lambda(cls, values, names):
    """from_dict for families with a parameter named lambda."""
    if [k for k in values if k != "type"] != names:
        raise ValueError(f"{cls.tag}: expected {names} in this order, got {list(values)}")
    return cls(*(values[k] for k in names))


@register_emission
@dataclass(frozen=True)
class Gamma(Emission):
    tag: ClassVar[str] = "Gamma"
    k: float = 1.0
    theta: float = 1.0

    def valid(self) -> bool:
        return _positive(self.k, self.theta)

    def log_density(self, o, x):
        base = self.k * math.log(self.theta) + special.lgamma(self.k)
        return o.where(o.finite(x) & (x > 0), (self.k - 1) * o.log(x) - x / self.theta - base, o.never)

    def point_log_density(self, o, x):
        return o.where((x == 0) & (x == x), o.const(INF if self.k < 1 else -INF), self.log_density(o, x))

    def cdf(self, x):
        return special.gamma_p(self.k, np.asarray(x, float) / self.theta)

    def _moments(self):
        return self.k * self.theta, self.k * self.theta**2, {"mode": max(0.0, self.k - 1) * self.theta, "rate": 1 / self.theta}

    def sample(self, rng, n):
        return rng.gamma(self.k, self.theta, n)

    def fitting(self, weighted):
        s = yield {"n": COUNT, "all": TOTAL, "w": _weigh(_above), "x": _weigh(_above, lambda o, x: x), "lx": _weigh(_above, lambda o, x: o.log(x))}
        if not weighted and (s["n"] < 2 or s["w"] < 2):
            return self.reset()
        if weighted and not s["all"] >= ZERO:
            return self
        if s["w"] < ZERO:
            return self.reset()
        mean = s["x"] / s["w"]
        gap = math.log(mean) - s["lx"] / s["w"]
        if gap <= 0:
            return Gamma(1.0, mean)
        # ln k - digamma(k) falls from infinity to 0, as 1 / (2 k) for large k
        k = solve(lambda k: gap - math.log(k) + digamma(k), 0.5 / gap, 1e-10, 1e15)
        return Gamma(k, mean / k) if _positive(k, mean / k) else self.reset()


@register_emission
@dataclass(frozen=True)
class LogNormal(Emission):
    tag: ClassVar[str] = "LogNormal"
    mu: float = 0.0
    sigma: float = 1.0

    def valid(self) -> bool:
        return math.isfinite(self.mu) and _positive(self.sigma)

    def log_density(self, o, x):
        z = (o.log(x) - self.mu) / self.sigma
        return o.where(o.finite(x) & (x > 0), -o.log(x) - math.log(self.sigma * math.sqrt(2 * math.pi)) - 0.5 * z * z, o.never)

    def cdf(self, x):
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            z = (np.log(np.where(x > 0, x, 1)) - self.mu) / (self.sigma * math.sqrt(2))
        return np.where(x > 0, 0.5 * (1 + special.erf(z)), 0.0)

    def _moments(self):
        v = self.sigma**2
        return math.exp(self.mu + v / 2), math.expm1(v) * math.exp(2 * self.mu + v), {"mode": math.exp(self.mu - v), "median": math.exp(self.mu)}

    def sample(self, rng, n):
        return rng.lognormal(self.mu, self.sigma, n)

    def fitting(self, weighted):
        c = self.mu
        s = yield {"n": COUNT, "all": TOTAL, "in": _weigh(_above), "d": _weigh(_above, lambda o, x: o.log(x) - c), "dd": _weigh(_above, lambda o, x: (o.log(x) - c) * (o.log(x) - c))}
        if not weighted:
            if s["in"] == 0:
                return self.reset()
            mean = s["d"] / s["in"]
            if s["in"] == 1:
                return LogNormal(c + mean, special.LIMIT)
            sd = math.sqrt(max(0.0, s["dd"] / s["in"] - mean * mean))
        else:
            if not s["all"] >= ZERO:
                return self
            # the divisor is all weight, also that of observations outside the support
            m = c * s["in"] / s["all"] + s["d"] / s["all"]
            mean = m - c
            sd = math.sqrt(max(0.0, (s["dd"] - 2 * mean * s["d"] + mean * mean * s["in"]) / s["all"]))
        return LogNormal(c + mean, sd) if math.isfinite(mean) and math.isfinite(sd) and sd > ZERO else self.reset()


@register_emission
@dataclass(frozen=True)
class Beta(Emission):
    tag: ClassVar[str] = "Beta"
    alpha: float = 1.0
    beta: float = 1.0

    def valid(self) -> bool:
        return _positive(self.alpha, self.beta)

    def _log_norm(self) -> float:
        return special.lgamma(self.alpha) + special.lgamma(self.beta) - special.lgamma(self.alpha + self.beta)

    def log_density(self, o, x):
        inside = (self.alpha - 1) * o.log(x) + (self.beta - 1) * o.log(1.0 - x) - self._log_norm()
        return o.where(o.finite(x) & (x > 0) & (x < 1), inside, o.never)

    def point_log_density(self, o, x):
        def end(shape: float, other: float) -> float:
            return INF if shape < 1 else math.log(other) if shape == 1 else -INF

        inner = o.where((x == 1) & (x == x), o.const(end(self.beta, self.alpha)), self.log_density(o, x))
        return o.where((x == 0) & (x == x), o.const(end(self.alpha, self.beta)), inner)

    def cdf(self, x):
        return special.beta_i(x, self.alpha, self.beta)

    def _moments(self):
        t = self.alpha + self.beta
        return self.alpha / t, self.alpha * self.beta / (t * t * (t + 1)), {}

    def sample(self, rng, n):
        return rng.beta(self.alpha, self.beta, n)

    def fitting(self, weighted):
        unit = lambda o, x: o.finite(x) & (x >= 0) & (x <= 1)
        low = lambda o, x: o.most(o.least(x, 1.0 - 1e-15), 1e-15)
        s = yield {
            "n": COUNT, "all": TOTAL, "w": _weigh(unit), "x": _weigh(unit, lambda o, x: x), "xx": _weigh(unit, lambda o, x: x * x),
            "lx": _weigh(unit, lambda o, x: o.log(low(o, x))), "ly": _weigh(unit, lambda o, x: o.log(1.0 - low(o, x))),
        }
        if not weighted:
            if s["n"] < 2:
                return self.reset()
            if s["w"] < s["n"]:
                raise ValueError("Beta: observations outside of [0, 1]")
        elif not s["all"] >= ZERO:
            return self
        if s["w"] < ZERO:
            return self.reset()
        w = s["w"]
        mean = s["x"] / w
        variance = s["xx"] / w - mean * mean
        if not weighted:
            variance *= w / (w - 1)
        if variance <= ZERO or mean <= ZERO or mean >= 1 or (factor := mean * (1 - mean) / variance - 1) <= ZERO:
            return self.reset()
        a, b = _beta_shapes(mean * factor, (1 - mean) * factor, s["lx"] / w, s["ly"] / w)
        return Beta(a, b) if all(math.isfinite(v) and ZERO < v < special.MAX_PARAMETER for v in (a, b)) else self.reset()


def _beta_shapes(a: float, b: float, lx: float, ly: float) -> tuple[float, float]:
    """The shapes whose expected ln x and ln(1 - x) are lx and ly.

    They maximise a lx + b ly - ln B(a, b), which is concave: Newton steps with the full matrix of second derivatives,
    halved until they stay in range and don't lose height."""

    def height(a: float, b: float) -> float:
        return a * lx + b * ly - special.lgamma(a) - special.lgamma(b) + special.lgamma(a + b)

    now = height(a, b)
    for _ in range(200):
        common, bend = digamma(a + b), trigamma(a + b)
        rise = np.array([lx - digamma(a) + common, ly - digamma(b) + common])
        curve = np.array([[trigamma(a) - bend, -bend], [-bend, trigamma(b) - bend]])
        if not np.isfinite(curve).all() or np.linalg.det(curve) <= 0:
            break
        da, db = np.linalg.solve(curve, rise)
        part = 1.0
        while part > 1e-12 and (a + part * da <= 0 or b + part * db <= 0 or height(a + part * da, b + part * db) < now - 1e-13 * (1 + abs(now))):
            part /= 2
        a, b = a + part * da, b + part * db
        now = height(a, b)
        if abs(da) <= 1e-12 * a and abs(db) <= 1e-12 * b or part <= 1e-12:
            break
    return float(a), float(b)


@register_emission
@dataclass(frozen=True)
class Uniform(Emission):
    tag: ClassVar[str] = "Uniform"
    a: float = 0.0
    b: float = 1.0

    def valid(self) -> bool:
        return math.isfinite(self.a) and math.isfinite(self.b) and self.a < self.b

    def log_density(self, o, x):
        return o.where(o.finite(x) & (x >= self.a) & (x <= self.b), o.const(-math.log(self.b - self.a)), o.never)

    def cdf(self, x):
        return np.clip((np.asarray(x, float) - self.a) / (self.b - self.a), 0, 1)

    def cdf_column(self, x):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - self.a) / (self.b - self.a)))

    def _moments(self):
        return (self.a + self.b) / 2, (self.b - self.a) ** 2 / 12, {}

    def sample(self, rng, n):
        return rng.uniform(self.a, self.b, n)

    def fitting(self, weighted):
        if weighted:
            c = (self.a + self.b) / 2
            s = yield {"w": TOTAL, "d": _weigh(_finite, lambda o, x: x - c), "dd": _weigh(_finite, lambda o, x: (x - c) * (x - c))}
            if not s["w"] >= ZERO:
                return self
            d = s["d"] / s["w"]
            half = math.sqrt(3 * max(0.0, s["dd"] / s["w"] - d * d))
            return Uniform(c + d - half, c + d + half) if special.MIN_PARAMETER <= half < INF else self.reset()
        s = yield {"n": COUNT, "bad": _sum(lambda o, x, w: o.where(o.finite(x), 0.0, 1.0)), "lo": ("min", lambda o, x, w: x), "hi": ("max", lambda o, x, w: x)}
        if s["n"] < 2:
            return self.reset()
        if s["bad"]:
            raise ValueError("Uniform: observations that aren't finite")
        spread = s["hi"] - s["lo"]
        pad = 0.05 * spread if spread else max(abs(s["lo"]), 1) * special.MIN_PARAMETER
        return Uniform(s["lo"] - pad, s["hi"] + pad)


@register_emission
@dataclass(frozen=True)
class Weibull(Emission):
    tag: ClassVar[str] = "Weibull"
    k: float = 1.0
    lambda_: float = 1.0

    def valid(self) -> bool:
        return _positive(self.k, self.lambda_)

    def params(self):
        return {"k": self.k, "lambda": self.lambda_}

    @classmethod
    def from_dict(cls, values):
        return _from_lambda(cls, values, ["k", "lambda"])

    def log_density(self, o, x):
        t = o.log(x) - math.log(self.lambda_)
        return o.where(o.finite(x) & (x > 0), math.log(self.k / self.lambda_) + (self.k - 1) * t - o.exp(self.k * t), o.never)

    def point_log_density(self, o, x):
        at_zero = -math.log(self.lambda_) if self.k == 1 else INF if self.k < 1 else -INF
        return o.where((x == 0) & (x == x), o.const(at_zero), self.log_density(o, x))

    def cdf(self, x):
        return -np.expm1(-((np.maximum(np.asarray(x, float), 0) / self.lambda_) ** self.k))

    def cdf_column(self, x):
        return -F.expm1(-F.pow(F.greatest(x, F.lit(0.0)) / self.lambda_, F.lit(float(self.k))))

    def _moments(self):
        g1, g2 = (math.exp(special.lgamma(1 + i / self.k)) for i in (1, 2))
        return self.lambda_ * g1, self.lambda_**2 * (g2 - g1 * g1), {}

    def sample(self, rng, n):
        return self.lambda_ * rng.weibull(self.k, n)

    def fitting(self, weighted):
        s = yield {
            "n": COUNT, "all": TOTAL, "w": _weigh(_above), "lx": _weigh(_above, lambda o, x: o.log(x)), "llx": _weigh(_above, lambda o, x: o.log(x) * o.log(x)),
            "top": ("max", lambda o, x, w: o.where(_above(o, x) & (w > 0), o.log(o.where(x > 0, x, 1.0)), o.const(-INF))),
        }
        if not weighted:
            if s["n"] < 2:
                return self.reset()
            if s["w"] < s["n"]:
                raise ValueError("Weibull: observations that aren't positive")
        elif not s["all"] >= ZERO:
            return self
        w, top = s["w"], s["top"]
        if w < ZERO:
            return self.reset()
        log_mean = s["lx"] / w
        # ln x has the variance pi^2 / (6 k^2)
        spread = s["llx"] / w - log_mean * log_mean
        seed = math.pi / math.sqrt(6 * spread) if spread > 1e-12 else 1.0

        def powers(k: float, i: int) -> dict[str, Stat]:
            # (x / largest x)^k: no power overflows
            grown = lambda o, x: o.exp(o.most(k * (o.log(x) - top), -700.0))
            return {f"a{i}": _weigh(_above, grown), f"b{i}": _weigh(_above, lambda o, x: grown(o, x) * (o.log(x) - top))}

        search = special.root_search(seed, special.MIN_PARAMETER, special.MAX_PARAMETER)
        try:
            ks = next(search)
            while True:
                p = yield {n: stat for i, k in enumerate(ks) for n, stat in powers(k, i).items()}
                # the profile score rises in k
                ks = search.send([p[f"b{i}"] / p[f"a{i}"] + top - 1 / k - log_mean if p[f"a{i}"] > 0 else math.nan for i, k in enumerate(ks)])
        except StopIteration as end:
            k = end.value
        p = yield powers(k, 0)
        scale = math.exp(top + math.log(p["a0"] / w) / k) if p["a0"] > 0 else 1.0
        return Weibull(k, scale) if all(math.isfinite(v) and ZERO < v < special.MAX_PARAMETER for v in (k, scale)) else self.reset()


@register_emission
@dataclass(frozen=True)
class Pareto(Emission):
    tag: ClassVar[str] = "Pareto"
    k: float = 1.0
    xm: float = 1.0

    def valid(self) -> bool:
        return _positive(self.k, self.xm)

    def log_density(self, o, x):
        return o.where(o.finite(x) & (x >= self.xm), math.log(self.k) + self.k * math.log(self.xm) - (self.k + 1) * o.log(x), o.never)

    def cdf(self, x):
        return 1 - (self.xm / np.maximum(np.asarray(x, float), self.xm)) ** self.k

    def cdf_column(self, x):
        return 1 - F.pow(self.xm / F.greatest(x, F.lit(float(self.xm))), F.lit(float(self.k)))

    def _moments(self):
        k, m = self.k, self.xm
        mean = k * m / (k - 1) if k > 1 else INF
        return mean, m * m * k / ((k - 1) ** 2 * (k - 2)) if k > 2 else INF, {"mode": m, "median": m * 2 ** (1 / k)}

    def sample(self, rng, n):
        return self.xm * (1 + rng.pareto(self.k, n))

    def fitting(self, weighted):
        if weighted:
            lows: Stat = ("min", lambda o, x, w: o.where(o.finite(x) & (x > 0) & (w > 0), x, o.const(INF)))
        else:
            lows = ("min", lambda o, x, w: x)
        s = yield {"n": COUNT, "all": TOTAL, "lo": lows, "in": _weigh(_above), "lx": _weigh(_above, lambda o, x: o.log(x))}
        if weighted and not s["all"] >= ZERO:
            return self
        if (not weighted and s["n"] < 2) or not 0 < s["lo"] < INF:
            return self.reset()
        logs = s["lx"] - s["in"] * math.log(s["lo"])
        if logs <= 0 or not _positive(s["all"] / logs):
            return self.reset()
        return Pareto(s["all"] / logs, s["lo"])


@register_emission
@dataclass(frozen=True)
class Rayleigh(Emission):
    tag: ClassVar[str] = "Rayleigh"
    sigma: float = 1.0

    def valid(self) -> bool:
        return _positive(self.sigma)

    def log_density(self, o, x):
        return o.where(o.finite(x) & (x > 0), o.log(x) - 2 * math.log(self.sigma) - x * x / (2 * self.sigma**2), o.never)

    def cdf(self, x):
        x = np.maximum(np.asarray(x, float), 0)
        return -np.expm1(-x * x / (2 * self.sigma**2))

    def cdf_column(self, x):
        above = F.greatest(x, F.lit(0.0))
        return -F.expm1(-above * above / (2 * self.sigma**2))

    def _moments(self):
        s = self.sigma
        return s * math.sqrt(math.pi / 2), (4 - math.pi) / 2 * s * s, {"mode": s, "median": s * math.sqrt(2 * math.log(2))}

    def sample(self, rng, n):
        return rng.rayleigh(self.sigma, n)

    def fitting(self, weighted):
        s = yield {"n": COUNT, "all": TOTAL, "bad": _sum(lambda o, x, w: o.where(x > 0, 0.0, 1.0)), "xx": _weigh(_above, lambda o, x: x * x)}
        if not weighted and (s["n"] == 0 or s["bad"]):
            return self.reset()
        if not s["all"] >= ZERO:
            return self
        sigma = math.sqrt(s["xx"] / (2 * s["all"]))
        return Rayleigh(sigma) if _positive(sigma) else self.reset()


@register_emission
@dataclass(frozen=True)
class StudentT(Emission):
    """A fit takes one conditional-maximisation step from the present parameters; repeated fits converge."""

    tag: ClassVar[str] = "StudentT"
    df: float = 1.0
    mu: float = 0.0
    sigma: float = 1.0

    def valid(self) -> bool:
        return math.isfinite(self.mu) and _positive(self.df, self.sigma)

    def log_density(self, o, x):
        v = self.df
        base = special.lgamma((v + 1) / 2) - special.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(self.sigma)
        z = (x - self.mu) / self.sigma
        return o.where(o.finite(x), base - (v + 1) / 2 * o.log(1.0 + z * z / v), o.never)

    def cdf(self, x):
        t = (np.asarray(x, float) - self.mu) / self.sigma
        tail = 0.5 * special.beta_i(self.df / (self.df + t * t), self.df / 2, 0.5)
        return np.where(t > 0, 1 - tail, tail)

    def _moments(self):
        v = self.df
        variance = self.sigma**2 * v / (v - 2) if v > 2 else INF if v > 1 else math.nan
        return self.mu if v > 1 else math.nan, variance, {"mode": self.mu}

    def sample(self, rng, n):
        return self.mu + self.sigma * rng.standard_t(self.df, n)

    def fitting(self, weighted):
        v, m, s2 = self.df, self.mu, self.sigma**2
        square = lambda x: (x - m) * (x - m) / s2
        e = lambda x: (v + 1) / (v + square(x))
        s = yield {
            "n": COUNT, "all": TOTAL, "in": _weigh(_finite), "e": _weigh(_finite, lambda o, x: e(x)), "ed": _weigh(_finite, lambda o, x: e(x) * (x - m)),
            "edd": _weigh(_finite, lambda o, x: e(x) * (x - m) * (x - m)), "lz": _weigh(_finite, lambda o, x: o.log(0.5 * (v + square(x)))),
        }
        if not weighted:
            if s["n"] < 2:
                return self.reset()
            if s["in"] < s["n"]:
                raise ValueError("StudentT: observations that aren't finite")
        elif not s["all"] >= ZERO:
            return self
        failed = self if weighted else self.reset()
        if s["e"] < ZERO:
            return failed
        total, d = s["all"], s["ed"] / s["e"]
        variance = (s["edd"] - s["ed"] * d) / total
        if not _positive(variance):
            return failed
        # with h half the new df, ln h - digamma(h) must come to what the data leave open
        open_ = (s["lz"] + s["e"]) / total - digamma((v + 1) / 2) - 1
        df = 2 * solve(lambda h: open_ - math.log(h) + digamma(h), v / 2, special.MIN_DF / 2, special.MAX_DF / 2)
        return StudentT(min(max(df, special.MIN_DF), special.MAX_DF), m + d, math.sqrt(variance))


@register_emission
@dataclass(frozen=True)
class ChiSquared(Emission):
    tag: ClassVar[str] = "ChiSquared"
    k: float = 1.0

    def valid(self) -> bool:
        return _positive(self.k)

    def log_density(self, o, x):
        h = self.k / 2
        return o.where(o.finite(x) & (x > 0), (h - 1) * o.log(x) - 0.5 * x - (h * math.log(2) + special.lgamma(h)), o.never)

    def point_log_density(self, o, x):
        at_zero = INF if self.k < 2 else math.log(0.5) if self.k == 2 else -INF
        return o.where((x == 0) & (x == x), o.const(at_zero), self.log_density(o, x))

    def cdf(self, x):
        return special.gamma_p(self.k / 2, np.asarray(x, float) / 2)

    def _moments(self):
        return self.k, 2 * self.k, {"mode": max(0.0, self.k - 2)}

    def sample(self, rng, n):
        return rng.chisquare(self.k, n)

    def fitting(self, weighted):
        bad = _sum(lambda o, x, w: o.where(o.finite(x) & (x >= 0), 0.0, 1.0))
        s = yield {"n": COUNT, "bad": bad, "w": _weigh(_above), "x": _weigh(_above, lambda o, x: x), "lx": _weigh(_above, lambda o, x: o.log(x))}
        if not weighted:
            if s["n"] == 0 or s["bad"]:
                raise ValueError("ChiSquared: no observations, or some that are negative or not finite")
            if s["w"] == 0:
                return self.reset()
        if not s["w"] >= ZERO:
            return self
        want = s["lx"] / s["w"] - math.log(2)
        half = solve(lambda g: digamma(g) - want, max(s["x"] / s["w"] / 2, special.MIN_DF), special.MIN_DF / 2, special.MAX_DF / 2)
        return ChiSquared(2 * half)


@register_emission
@dataclass(frozen=True)
class VonMises(Emission):
    tag: ClassVar[str] = "VonMises"
    mu: float = 0.0
    kappa: float = 1.0

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "mu", wrap_angle(self.mu))

    def valid(self) -> bool:
        return math.isfinite(self.mu) and math.isfinite(self.kappa) and self.kappa >= 0

    def log_density(self, o, x):
        return o.where(o.finite(x), self.kappa * o.cos(x - self.mu) - (math.log(2 * math.pi) + special.log_i0(self.kappa)), o.never)

    def cdf(self, x):
        """From -pi, by the trapezoid rule in 512 steps."""
        x = np.asarray(x, float)
        end = np.clip(np.where(np.isfinite(x), np.vectorize(wrap_angle, otypes=[float])(np.where(np.isfinite(x), x, 0.0)), x), -math.pi, math.pi)
        grid = -math.pi + (end[..., None] + math.pi) * np.linspace(0, 1, 513)
        p = np.exp(self.log_density(Arrays, grid))
        return np.clip(((p[..., 1:] + p[..., :-1]) / 2).sum(-1) * (end + math.pi) / 512, 0, 1)

    def _moments(self):
        spread = 1 - special.bessel_ratio(self.kappa)
        return self.mu, spread, {"circular_variance": spread}

    def sample(self, rng, n):
        return rng.vonmises(self.mu, self.kappa, n)

    def fitting(self, weighted):
        s = yield {"n": COUNT, "w": _weigh(_finite), "s": _weigh(_finite, lambda o, x: o.sin(x)), "c": _weigh(_finite, lambda o, x: o.cos(x))}
        if not weighted and s["n"] == 0:
            return self.reset()
        if not s["w"] >= ZERO:
            return self
        return VonMises(math.atan2(s["s"], s["c"]), concentration(math.hypot(s["s"], s["c"]) / s["w"]))


def wrap_angle(x: float) -> float:
    """x in (-pi, pi]."""
    y = math.remainder(x, 2 * math.pi)
    return math.pi if y == -math.pi else y


def concentration(r: float) -> float:
    """The von Mises kappa of mean resultant length r."""
    if r <= 0:
        return 0.0
    if r >= 1:
        return special.MAX_PARAMETER
    return solve(lambda k: special.bessel_ratio(k) - r, r / (1 - r), 1e-12, special.MAX_PARAMETER)


@register_emission
@dataclass(frozen=True)
class Discrete(Emission):
    """Symbols 0 .. n - 1; an observation is cut to its whole part."""

    tag: ClassVar[str] = "Discrete"
    discrete: ClassVar[bool] = True
    probs: tuple[float, ...] = (0.1,) * 10

    def __post_init__(self) -> None:
        object.__setattr__(self, "probs", tuple(float(p) for p in self.probs))
        super().__post_init__()

    def valid(self) -> bool:
        return len(self.probs) > 0 and all(math.isfinite(p) and 0 <= p <= 1 for p in self.probs)

    def reset(self):
        return Discrete((1 / len(self.probs),) * len(self.probs))

    @property
    def n_params(self) -> int:
        return len(self.probs) - 1

    def to_dict(self):
        return {"type": self.tag, "n": len(self.probs), "probs": list(self.probs)}

    @classmethod
    def from_dict(cls, values):
        if [k for k in values if k != "type"] != ["n", "probs"] or values["n"] != len(values["probs"]):
            raise ValueError("Discrete: expected n and as many probs")
        return cls(tuple(values["probs"]))

    def log_density(self, o, x):
        logs = [math.log(p) if p > 0 else -INF for p in self.probs]
        k = o.trunc(x)
        return o.where(o.finite(x) & (k >= 0) & (k < len(logs)), o.pick(logs, k), o.never)

    def cdf(self, x):
        steps = np.concatenate([[0.0], np.minimum(np.cumsum(self.probs), 1)])
        return steps[np.clip(np.floor(np.nan_to_num(np.asarray(x, float))) + 1, 0, len(self.probs)).astype(int)]

    def cdf_column(self, x):
        steps = [0.0, *np.minimum(np.cumsum(self.probs), 1).tolist()]
        place = F.least(F.lit(len(self.probs)), F.greatest(F.lit(0), F.floor(x) + 1)).cast("int")
        return F.element_at(F.array(*map(F.lit, steps)), place + 1)

    def _moments(self):
        p, k = np.array(self.probs), np.arange(len(self.probs))
        mean = float(p @ k)
        entropy = float(-sum(v * math.log(v) for v in self.probs if v > 0))
        return mean, float(p @ k**2 - mean * mean), {"mode": float(p.argmax()), "entropy": entropy, "probability_sum": float(p.sum())}

    def sample(self, rng, n):
        p = np.array(self.probs)
        return rng.choice(len(p), n, p=p / p.sum()).astype(float)

    def fitting(self, weighted):
        symbol = lambda i: lambda o, x: o.finite(x) & (o.trunc(x) == float(i))
        s = yield {"n": COUNT} | {f"p{i}": _weigh(symbol(i)) for i in range(len(self.probs))}
        total = sum(s[f"p{i}"] for i in range(len(self.probs)))
        if total < ZERO:  # a weighted fit without weight in range keeps the parameters
            return self if weighted else self.reset()
        return Discrete(tuple(min(1.0, s[f"p{i}"] / total) for i in range(len(self.probs))))


@register_emission
@dataclass(frozen=True)
class Poisson(Emission):
    tag: ClassVar[str] = "Poisson"
    discrete: ClassVar[bool] = True
    lambda_: float = 1.0

    def valid(self) -> bool:
        return _positive(self.lambda_)

    def params(self):
        return {"lambda": self.lambda_}

    @classmethod
    def from_dict(cls, values):
        return _from_lambda(cls, values, ["lambda"])

    def log_density(self, o, x):
        return o.where(o.finite(x) & (x >= 0) & (o.floor(x) == x), x * math.log(self.lambda_) - self.lambda_ - o.lgamma(x + 1.0), o.never)

    def cdf(self, x):
        k, at = np.unique(np.floor(np.asarray(x, float)), return_inverse=True)
        steps = [0.0 if v < 0 else v if math.isnan(v) else 1 - special.gamma_p(v + 1, self.lambda_) if v < INF else 1.0 for v in k]
        return np.array(steps, float)[at].reshape(np.shape(x))

    def _moments(self):
        return self.lambda_, self.lambda_, {}

    def sample(self, rng, n):
        return rng.poisson(self.lambda_, n).astype(float)

    def fitting(self, weighted):
        bad = _sum(lambda o, x, w: o.where(o.finite(x) & (x >= 0) & (o.floor(x) == x), 0.0, 1.0))
        s = yield {"n": COUNT, "bad": bad, "w": TOTAL, "x": _weigh(_finite, lambda o, x: x)}
        if not weighted:
            if s["n"] == 0:
                return self.reset()
            if s["bad"]:
                raise ValueError("Poisson: observations that aren't counts")
        if not s["w"] >= ZERO:
            return self
        return Poisson(max(s["x"] / s["w"], ZERO))


@register_emission
@dataclass(frozen=True)
class Binomial(Emission):
    tag: ClassVar[str] = "Binomial"
    discrete: ClassVar[bool] = True
    n: int = 10
    p: float = 0.5

    def __post_init__(self) -> None:
        object.__setattr__(self, "n", int(self.n))
        super().__post_init__()

    def valid(self) -> bool:
        return self.n > 0 and 0 <= self.p <= 1

    def log_density(self, o, x):
        k = o.half_away(x)
        log_p, log_q = (math.log(v) if v > 0 else -INF for v in (self.p, 1 - self.p))
        choose = special.log_factorial(self.n) - o.lgamma(o.where(k >= 0, k, 0.0) + 1.0) - o.lgamma(o.where(k <= self.n, float(self.n) - k, 0.0) + 1.0)
        heads = o.where(k == 0, 0.0, o.where(k > 0, k, 1.0) * log_p)  # 0 * -inf counts as 0
        tails = o.where(k == self.n, 0.0, o.where(k < self.n, float(self.n) - k, 1.0) * log_q)
        return o.where(o.finite(x) & (k >= 0) & (k <= self.n), choose + heads + tails, o.never)

    def cdf(self, x):
        steps = np.concatenate([[0.0], np.minimum(np.cumsum(np.exp(self.logpdf(np.arange(self.n + 1)))), 1)])
        return steps[np.clip(np.floor(np.asarray(x, float)) + 1, 0, self.n + 1).astype(int)]

    def _moments(self):
        return self.n * self.p, self.n * self.p * (1 - self.p), {}

    def sample(self, rng, n):
        return rng.binomial(self.n, self.p, n).astype(float)

    def fitting(self, weighted):
        ok = lambda o, x: o.finite(x) & (x >= 0)
        s = yield {
            "n": COUNT, "all": TOTAL, "w": _weigh(ok), "k": _weigh(ok, lambda o, x: o.half_away(x)),
            "hi": ("max", lambda o, x, w: o.where(ok(o, x) & (w > 0), o.half_away(x), 0.0)),
        }
        if not weighted and (s["n"] == 0 or s["w"] == 0):
            return self.reset()
        total = s["all"] if weighted else s["w"]
        if not total >= ZERO:
            return self
        most = max(0, int(s["hi"])) if math.isfinite(s["hi"]) else 0
        return Binomial(most, min(1.0, max(0.0, s["k"] / total / most))) if most else Binomial(1, 0.0)


@register_emission
@dataclass(frozen=True)
class NegativeBinomial(Emission):
    tag: ClassVar[str] = "NegativeBinomial"
    discrete: ClassVar[bool] = True
    r: float = 5.0
    p: float = 0.5

    def valid(self) -> bool:
        return _positive(self.r) and 0 < self.p <= 1

    def log_density(self, o, x):
        log_q = math.log1p(-self.p) if self.p < 1 else -INF

        def body(k):
            kk = o.where(k >= 0, k, 0.0)
            fails = o.where(kk == 0, 0.0, o.where(kk > 0, kk, 1.0) * log_q)
            inside = o.lgamma(kk + self.r) - o.lgamma(kk + 1.0) - special.lgamma(self.r) + self.r * math.log(self.p) + fails
            return o.where(o.finite(x) & (k >= 0), inside, o.never)

        return o.bind(o.half_away(x), body)

    def cdf(self, x):
        """Summed up to 1000."""
        steps = np.concatenate([[0.0], np.minimum(np.cumsum(np.exp(self.logpdf(np.arange(1001)))), 1)])
        return steps[np.clip(np.floor(np.nan_to_num(np.asarray(x, float))) + 1, 0, 1001).astype(int)]

    def _moments(self):
        r, p = self.r, self.p
        q = 1 - p
        more = {"mode": math.floor((r - 1) * q / p) if r > 1 else 0.0}
        more |= {"skewness": (2 - p) / math.sqrt(r * q), "kurtosis": 6 / r + p * p / (r * q)} if q else {}
        return r * q / p, r * q / p**2, more

    def sample(self, rng, n):
        return rng.poisson(rng.gamma(self.r, (1 - self.p) / self.p, n)).astype(float)

    def fitting(self, weighted):
        ok = lambda o, x: o.finite(x) & (x >= 0)
        s = yield {"n": COUNT, "all": TOTAL, "w": _weigh(ok), "k": _weigh(ok, lambda o, x: o.half_away(x)), "kk": _weigh(ok, lambda o, x: o.half_away(x) * o.half_away(x))}
        if weighted and not s["all"] >= ZERO:
            return self
        w = s["w"]
        if w < ZERO or (not weighted and w < 2):
            return self.reset()
        mean = s["k"] / w
        variance = s["kk"] / w - mean * mean
        if not weighted:
            variance *= w / (w - 1)
        if variance <= mean or mean <= 0:
            return self.reset()
        search = special.root_search(mean * mean / (variance - mean), 1e-6, 1e9)
        try:
            rs = next(search)
            while True:
                # psi(k + r) - psi(r) summed over the data; the score falls in r
                gaps = yield {f"f{i}": _weigh(ok, (lambda r: lambda o, x: o.bind(o.half_away(x), lambda k: _psi_gap(o, k, r)))(r)) for i, r in enumerate(rs)}
                rs = search.send([math.log1p(mean / r) - gaps[f"f{i}"] / w for i, r in enumerate(rs)])
        except StopIteration as end:
            r = end.value
        p = r / (r + mean)
        return NegativeBinomial(r, p) if _positive(r) and ZERO < p <= 1 else self.reset()


def _psi_gap(o: Any, k: Any, r: float) -> Any:
    """psi(k + r) - psi(r), by the asymptotic series past eight steps up."""
    y = k + (r + 8.0)
    steps = None
    for i in range(8):
        term = 1.0 / (k + (r + i))
        steps = term if steps is None else steps + term
    inverse = 1.0 / (y * y)
    series = None
    for j in range(len(special.BERNOULLI), 0, -1):
        b = special.BERNOULLI[j - 1] / (2 * j)
        series = b * inverse if series is None else (series + b) * inverse
    return o.log(y) - 0.5 / y - series - steps - digamma(r)
