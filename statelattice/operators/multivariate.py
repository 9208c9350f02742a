"""Multivariate emission families over vectors: diagonal and full-covariance Gaussians, independent components."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import linalg, special
from ..functions.algebra import Arrays
from ..functions.special import ZERO
from .emissions import COUNT, TOTAL, Emission, Fit, Stat, family, register_emission

MAX_DIM = 1024


def _part(o: Any, x: Any, d: int) -> Any:
    """Component d of vectors; NULL where a column's vector has none (_ragged counts these)."""
    if o is not Arrays:
        return F.get(x, F.lit(d))
    if d >= x.shape[-1]:
        raise ValueError("a vector is shorter than the model's dimension")
    return x[..., d]


def _size_is(o: Any, x: Any, dim: int) -> Any:
    return np.full(x.shape[:-1], x.shape[-1] == dim) if o is Arrays else F.size(x) == dim


def _ragged(dim: int) -> Stat:
    """Vectors of another size than the model's."""
    return "sum", lambda o, x, w: o.where(_size_is(o, x, dim), 0.0, 1.0)


def _same_size(s: dict[str, float]) -> None:
    if s["ragged"]:
        raise ValueError(f"{s['ragged']:.0f} vectors differ in size from the model")


class _Vector(Emission):
    multivariate: ClassVar[bool] = True

    def logpdf(self, x: Any) -> np.ndarray:
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            return np.asarray(self.log_density(Arrays, x) + np.zeros(x.shape[:-1]))

    point_logpdf = logpdf

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        raise NotImplementedError


@register_emission
@dataclass(frozen=True)
class DiagonalGaussian(_Vector):
    tag: ClassVar[str] = "DiagonalGaussian"
    mean: tuple[float, ...] = (0.0,)
    var: tuple[float, ...] = (1.0,)

    def __post_init__(self) -> None:
        for name in ("mean", "var"):
            object.__setattr__(self, name, tuple(float(v) for v in getattr(self, name)))
        super().__post_init__()

    def valid(self) -> bool:
        return 0 < len(self.mean) == len(self.var) <= MAX_DIM and all(map(math.isfinite, self.mean)) and all(math.isfinite(v) and v > 0 for v in self.var)

    @property
    def dim(self) -> int:
        return len(self.mean)

    @property
    def n_params(self) -> int:
        return 2 * self.dim

    def reset(self):
        return DiagonalGaussian((0.0,) * self.dim, (1.0,) * self.dim)

    def to_dict(self):
        return {"type": self.tag, "dim": self.dim, "mean": list(self.mean), "var": list(self.var)}

    @classmethod
    def from_dict(cls, values):
        if [k for k in values if k != "type"] != ["dim", "mean", "var"] or not values["dim"] == len(values["mean"]) == len(values["var"]):
            raise ValueError("DiagonalGaussian: expected dim and as many means and variances")
        return cls(tuple(values["mean"]), tuple(values["var"]))

    def log_density(self, o, x):
        total = o.const(0.0)
        for d in range(self.dim):
            z = _part(o, x, d) - self.mean[d]
            total = total + z * z / self.var[d]
        base = 0.5 * (self.dim * math.log(2 * math.pi) + sum(map(math.log, self.var)))
        fits = _size_is(o, x, self.dim)
        return o.where(fits & o.finite(total), -0.5 * total - base, o.never)

    def logpdf(self, x):
        x = np.asarray(x, float)
        return np.full(x.shape[:-1], -math.inf) if x.shape[-1] != self.dim else super().logpdf(x)

    def _moments(self):
        return math.nan, math.nan, {}

    def sample(self, rng, n):
        return rng.normal(self.mean, np.sqrt(self.var), (n, self.dim))

    def fitting(self, weighted) -> Fit:
        want: dict[str, Stat] = {"n": COUNT, "w": TOTAL, "ragged": _ragged(self.dim)}
        for d in range(self.dim):
            want[f"d{d}"] = ("sum", (lambda d: lambda o, x, w: w * (_part(o, x, d) - self.mean[d]))(d))
            want[f"dd{d}"] = ("sum", (lambda d: lambda o, x, w: w * (_part(o, x, d) - self.mean[d]) * (_part(o, x, d) - self.mean[d]))(d))
        s = yield want
        _same_size(s)
        if not weighted and s["n"] < 2:
            return self.reset()
        if not s["w"] >= ZERO:
            return self
        shift = [s[f"d{d}"] / s["w"] for d in range(self.dim)]
        var = [max(s[f"dd{d}"] / s["w"] - shift[d] ** 2, special.MIN_VAR) for d in range(self.dim)]
        return DiagonalGaussian(tuple(m + h for m, h in zip(self.mean, shift, strict=True)), tuple(var))


@register_emission
@dataclass(frozen=True)
class FullCovarianceGaussian(_Vector):
    """The covariance is kept as estimated; `reg` is added to its diagonal where it is factored."""

    tag: ClassVar[str] = "FullCovarianceGaussian"
    mean: tuple[float, ...] = (0.0,)
    cov: tuple[tuple[float, ...], ...] = ((1.0,),)
    reg: float = special.RIDGE

    def __post_init__(self) -> None:
        object.__setattr__(self, "mean", tuple(float(v) for v in self.mean))
        object.__setattr__(self, "cov", tuple(tuple(float(v) for v in row) for row in self.cov))
        super().__post_init__()

    def valid(self) -> bool:
        return 0 < len(self.mean) == len(self.cov) <= MAX_DIM and all(len(r) == len(self.mean) for r in self.cov) and self.reg >= 0 and self.factor() is not None

    def factor(self) -> np.ndarray | None:
        return linalg.cholesky(np.array(self.cov) + self.reg * np.eye(len(self.mean)))

    @property
    def dim(self) -> int:
        return len(self.mean)

    @property
    def n_params(self) -> int:
        return self.dim + self.dim * (self.dim + 1) // 2

    def reset(self):
        return FullCovarianceGaussian((0.0,) * self.dim, tuple(map(tuple, np.eye(self.dim).tolist())), self.reg)

    def to_dict(self):
        return {"type": self.tag, "dim": self.dim, "reg": self.reg, "mean": list(self.mean), "cov": [v for row in self.cov for v in row]}

    @classmethod
    def from_dict(cls, values):
        if [k for k in values if k != "type"] != ["dim", "reg", "mean", "cov"]:
            raise ValueError("FullCovarianceGaussian: expected dim, reg, mean and cov")
        n = values["dim"]
        flat = np.asarray(values["cov"], float).reshape(-1)
        if len(values["mean"]) != n or len(flat) != n * n:
            raise ValueError("FullCovarianceGaussian: dim doesn't fit mean and cov")
        return cls(tuple(values["mean"]), tuple(map(tuple, flat.reshape(n, n).tolist())), values["reg"])

    def log_density(self, o, x):
        # with P the inverse of the factor, the squared distance is the sum of (P (x - mean))^2
        lower = self.factor()
        inverse = linalg.forward_substitute(lower, np.eye(self.dim))
        total = o.const(0.0)
        for i in range(self.dim):
            y = o.const(0.0)
            for j in range(i + 1):
                y = y + (_part(o, x, j) - self.mean[j]) * float(inverse[i, j])
            total = total + y * y
        base = 0.5 * (self.dim * math.log(2 * math.pi) + linalg.log_det(lower))
        return o.where(_size_is(o, x, self.dim) & o.finite(total), -0.5 * total - base, o.never)

    def logpdf(self, x):
        x = np.asarray(x, float)
        if x.shape[-1] != self.dim:
            return np.full(x.shape[:-1], -math.inf)
        lower = self.factor()
        flat = x.reshape(-1, self.dim)
        with np.errstate(all="ignore"):
            d = linalg.mahalanobis(lower, flat, np.array(self.mean)) if len(flat) else np.zeros(0)
        out = np.where(np.isfinite(d), -0.5 * (d + self.dim * math.log(2 * math.pi) + linalg.log_det(lower)), -math.inf)
        return out.reshape(x.shape[:-1])

    def _moments(self):
        return math.nan, math.nan, {}

    def sample(self, rng, n):
        return np.array(self.mean) + rng.standard_normal((n, self.dim)) @ self.factor().T

    def fitting(self, weighted) -> Fit:
        c = self.mean
        want: dict[str, Stat] = {"n": COUNT, "w": TOTAL, "ragged": _ragged(self.dim)}
        for i in range(self.dim):
            want[f"d{i}"] = ("sum", (lambda i: lambda o, x, w: w * (_part(o, x, i) - c[i]))(i))
            for j in range(i + 1):
                want[f"c{i}_{j}"] = ("sum", (lambda i, j: lambda o, x, w: w * (_part(o, x, i) - c[i]) * (_part(o, x, j) - c[j]))(i, j))
        s = yield want
        _same_size(s)
        if not weighted and s["n"] < 2:
            return self.reset()
        if not s["w"] >= ZERO:
            return self
        shift = np.array([s[f"d{i}"] / s["w"] for i in range(self.dim)])
        cov = np.zeros((self.dim, self.dim))
        for i in range(self.dim):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = s[f"c{i}_{j}"] / s["w"] - shift[i] * shift[j]
        if linalg.cholesky(cov + self.reg * np.eye(self.dim)) is None:
            return self
        return FullCovarianceGaussian(tuple((np.array(c) + shift).tolist()), tuple(map(tuple, cov.tolist())), self.reg)


@register_emission
@dataclass(frozen=True)
class IndependentComponents(_Vector):
    """One scalar emission for each component; scored by the scalar (point) rule at boundaries."""

    tag: ClassVar[str] = "IndependentComponents"
    components: tuple[Emission, ...] = ()

    def valid(self) -> bool:
        return 0 < len(self.components) <= MAX_DIM and not any(e.multivariate for e in self.components)

    @property
    def dim(self) -> int:
        return len(self.components)

    @property
    def n_params(self) -> int:
        return sum(e.n_params for e in self.components)

    @property
    def all_discrete(self) -> bool:
        return all(e.discrete for e in self.components)

    def reset(self):
        return IndependentComponents(tuple(e.reset() for e in self.components))

    def params(self):
        return {"components": [e.to_dict() for e in self.components]}

    def to_dict(self):
        return {"type": self.tag, "dim": self.dim} | self.params()

    @classmethod
    def from_dict(cls, values):
        if [k for k in values if k != "type"] != ["dim", "components"] or values["dim"] != len(values["components"]):
            raise ValueError("IndependentComponents: expected dim and as many components")
        return cls(tuple(family(c["type"]).from_dict(c) for c in values["components"]))

    def log_density(self, o, x):
        total = o.const(0.0)
        for d, e in enumerate(self.components):
            total = total + e.point_log_density(o, _part(o, x, d))
        return o.where(_size_is(o, x, self.dim), total, o.never)

    def logpdf(self, x):
        x = np.asarray(x, float)
        if x.shape[-1] != self.dim:
            return np.full(x.shape[:-1], -math.inf)
        return sum(e.point_logpdf(x[..., d]) for d, e in enumerate(self.components))

    def _moments(self):
        return math.nan, math.nan, {}

    def sample(self, rng, n):
        return np.stack([e.sample(rng, n) for e in self.components], 1)

    def fitting(self, weighted) -> Fit:
        fits = [e.fitting(weighted) for e in self.components]
        done: dict[int, Emission] = {}
        wants: dict[int, dict[str, Stat]] = {}
        for d, fit in enumerate(fits):
            wants[d] = next(fit)
        while wants:
            def on(d: int, value: Any) -> Any:
                return lambda o, x, w: value(o, _part(o, x, d), w)

            got = yield {"ragged": _ragged(self.dim)} | {f"{d}_{name}": (how, on(d, value)) for d, want in wants.items() for name, (how, value) in want.items()}
            _same_size(got)
            again = {}
            for d, want in wants.items():
                try:
                    again[d] = fits[d].send({name: got[f"{d}_{name}"] for name in want})
                except StopIteration as end:
                    done[d] = end.value
            wants = again
        return IndependentComponents(tuple(done[d] for d in range(self.dim)))


def vector_column(parts: list[Column]) -> Column:
    """An observation vector from scalar columns."""
    return F.array(*(p.cast("double") for p in parts))


