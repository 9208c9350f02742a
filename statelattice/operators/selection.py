"""Model selection: free parameters and information criteria."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inference
from .model import Hmm


@dataclass(frozen=True)
class Criteria:
    aic: float
    bic: float
    aicc: float


def free_parameters(model: Hmm) -> int:
    """Transitions, initial probabilities and emissions; structural zeros count like others."""
    n = model.states
    return n * (n - 1) + (n - 1) + sum(e.n_params for e in model.emissions)


def aic(logp: float, k: int) -> float:
    return 2 * k - 2 * logp


def bic(logp: float, k: int, n: int) -> float:
    return k * math.log(n) - 2 * logp


def aicc(logp: float, k: int, n: int) -> float:
    """Infinite where n is too small for the correction."""
    return math.inf if n <= k + 1 else aic(logp, k) + 2 * k * (k + 1) / (n - k - 1)


def evaluate(sequences: DataFrame, model: Hmm) -> Criteria:
    """Criteria of a model, scalar or multivariate, over all observations."""
    n, logp = inference.total_log_likelihoods(sequences, {0: model})[0]
    k = free_parameters(model)
    return Criteria(aic(logp, k), bic(logp, k, n) if n else math.nan, aicc(logp, k, n))


def with_criteria(models: DataFrame) -> DataFrame:
    """models(logp, k, n, ...) with aic, bic and aicc."""
    logp, k, n = F.col("logp"), F.col("k").cast("double"), F.col("n").cast("double")
    plain: Column = 2 * k - 2 * logp
    small = F.when(n <= k + 1, F.lit(math.inf)).otherwise(plain + 2 * k * (k + 1) / (n - k - 1))
    return models.withColumn("aic", plain).withColumn("bic", k * F.ln(n) - 2 * logp).withColumn("aicc", small)


def compare(sequences: DataFrame, models: dict[str, Hmm]) -> DataFrame:
    """(model, logp, k, n, aic, bic, aicc): one row for each model, all scored in one pass over the sequences."""
    totals = inference.total_log_likelihoods(sequences, models)
    rows = [(name, float(logp), free_parameters(models[name]), n or None) for name, (n, logp) in totals.items()]
    return with_criteria(sequences.sparkSession.createDataFrame(rows, "model string, logp double, k int, n long"))
