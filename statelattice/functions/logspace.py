"""Sums and products in log space."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = -math.inf


def safe_log(values: np.ndarray) -> np.ndarray:
    """ln of non-negative numbers, minus infinity for zero (and for what is below it)."""
    values = np.asarray(values, float)
    return np.where(values > 0, np.log(np.where(values > 0, values, 1)), NEVER)


def log_sum(values: np.ndarray, axis: int = -1) -> np.ndarray:
    """ln sum exp along an axis; minus infinity where all are."""
    top = values.max(axis, keepdims=True)
    base = np.where(np.isneginf(top), 0, top)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(values - base).sum(axis, keepdims=True)) + base).squeeze(axis)


def log_add(a: float, b: float) -> float:
    """ln(e^a + e^b)."""
    high, low = max(a, b), min(a, b)
    return high if low == NEVER else high + math.log1p(math.exp(low - high))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(v) with v evaluated once: inside folds Catalyst doesn't share common subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_column(values: Column) -> Column:
    """ln sum exp of an array column."""

    def body(x: Column) -> Column:
        def given(top: Column) -> Column:
            total = F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y - top))
            return F.when(top == NEVER, top).otherwise(top + F.ln(total))

        return let(F.array_max(x), given)

    return let(values, body)
