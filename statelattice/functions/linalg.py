"""Cholesky factors and what multivariate densities need of them."""

from __future__ import annotations

import math

import numpy as np


def cholesky(matrix: np.ndarray) -> np.ndarray | None:
    """The lower factor of a symmetric matrix; None where a pivot isn't positive."""
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1] or not np.isfinite(matrix).all():
        return None
    try:
        return np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        return None


def log_det(lower: np.ndarray) -> float:
    return float(2 * np.log(np.diag(lower)).sum())


def forward_substitute(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with lower @ y = b (columns of b each by itself); NaN where the shapes don't fit."""
    lower, b = np.asarray(lower, float), np.asarray(b, float)
    if lower.shape[0] != b.shape[0]:
        return np.full(b.shape, math.nan)
    y = np.zeros_like(b)
    for i in range(len(lower)):
        y[i] = (b[i] - lower[i, :i] @ y[:i]) / lower[i, i]
    return y


def mahalanobis(lower: np.ndarray, rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Squared distances of rows from mean under the covariance with this factor."""
    y = forward_substitute(lower, (np.atleast_2d(rows) - mean).T)
    return (y * y).sum(0)
