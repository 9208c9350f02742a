"""One way to write a density or a statistic, two ways to evaluate it: Catalyst columns and NumPy arrays.

Both backends offer the same few functions; arithmetic and comparisons are the operands' own operators.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special
from .logspace import let


class _Columns:
    """Expressions of Spark columns. NULL never stands for minus infinity: a NULL condition takes the other branch."""

    @property
    def never(self) -> Column:
        return F.lit(-math.inf)

    @staticmethod
    def const(value: float) -> Column:
        return F.lit(float(value))

    @staticmethod
    def where(condition: Column, yes: Any, no: Any) -> Column:
        return F.when(condition, yes).otherwise(no)

    @staticmethod
    def finite(x: Column) -> Column:
        return ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))

    log, exp, sqrt, sin, cos, abs = map(staticmethod, (F.ln, F.exp, F.sqrt, F.sin, F.cos, F.abs))

    @staticmethod
    def floor(x: Column) -> Column:
        return F.floor(x).cast("double")

    @staticmethod
    def trunc(x: Column) -> Column:
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")

    @staticmethod
    def half_away(x: Column) -> Column:
        return F.when(x < 0, -F.floor(F.lit(0.5) - x)).otherwise(F.floor(x + 0.5)).cast("double")

    @staticmethod
    def pick(values: list[float], index: Column) -> Column:
        return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (index + 1).cast("int"))

    bind = staticmethod(let)

    @staticmethod
    def least(a: Column, b: float) -> Column:
        return F.least(a, F.lit(float(b)))

    @staticmethod
    def most(a: Column, b: float) -> Column:
        return F.greatest(a, F.lit(float(b)))

    @staticmethod
    def lgamma(x: Column) -> Column:
        """ln gamma(x), x > 0: eight steps of the recurrence and Stirling's series. x is bound once."""

        def body(x: Column) -> Column:
            y = x + 8.0
            inverse = 1.0 / (y * y)
            series = F.lit(0.0)
            for k in range(len(special.BERNOULLI), 0, -1):
                series = series * inverse + F.lit(special.BERNOULLI[k - 1] / (2 * k * (2 * k - 1)))
            product = x
            for i in range(1, 8):
                product = product * (x + float(i))
            return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series / y - F.ln(product)

        return let(x, body)


Columns = _Columns()


class Arrays:
    """Expressions of NumPy arrays; domain errors in branches that aren't taken stay silent."""

    never = -math.inf

    @staticmethod
    def const(value: float) -> float:
        return float(value)

    where = staticmethod(np.where)
    finite = staticmethod(np.isfinite)

    @staticmethod
    def log(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.log(x)

    @staticmethod
    def exp(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.exp(x)

    @staticmethod
    def sqrt(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(x)

    @staticmethod
    def sin(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sin(x)

    @staticmethod
    def cos(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.cos(x)

    abs, floor, trunc = staticmethod(np.abs), staticmethod(np.floor), staticmethod(np.trunc)

    @staticmethod
    def half_away(x: np.ndarray) -> np.ndarray:
        return np.copysign(np.floor(np.abs(x) + 0.5), x)

    @staticmethod
    def pick(values: list[float], index: np.ndarray) -> np.ndarray:
        return np.asarray(values)[np.clip(np.nan_to_num(index), 0, len(values) - 1).astype(int)]

    @staticmethod
    def bind(value: np.ndarray, body: Any) -> np.ndarray:
        return body(value)

    least, most = staticmethod(np.minimum), staticmethod(np.maximum)
    lgamma = staticmethod(special.lgamma)
