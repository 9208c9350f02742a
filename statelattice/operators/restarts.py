"""Training from several starts, keeping the likeliest result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inference, kmeans, training
from .emissions import fit_groups
from .model import Hmm


def randomized(sequences: DataFrame, model: Hmm, seed: int, restart: int) -> Hmm:
    """Scalar emissions refitted each to a few observations drawn by hash from the pool of all."""
    pool = sequences.select("seq_id", F.posexplode("xs").alias("t", "x"))
    size = pool.count()
    n = model.states
    m = max(2, min(32, size // (4 * n)))
    # about m * n rows: each state owns a thin slice of the hash range
    slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(restart), "seq_id", "t"), F.lit(max(n, size // m)))
    drawn = pool.withColumn("state", slot.cast("int")).where(F.col("state") < n)
    sizes = {r["state"]: r["n"] for r in drawn.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = fit_groups(drawn, {i: e for i, e in enumerate(model.emissions) if sizes.get(i, 0) >= 2}, "state", "x")
    return model.replace(emissions=tuple(fitted.get(i, e) for i, e in enumerate(model.emissions)))


def fit_best_of_n(sequences: DataFrame, model: Hmm, restarts: int, seed: int = 0, max_iterations: int = 500) -> training.Training:
    """Restart 0 is the model as given; others start from random scalar emissions or k-means (vectors). All train side
    by side, so the number of jobs is that of the longest. A restart
    that fails or ends without a log-likelihood is left out; the last failure is raised if none is left."""
    if restarts < 1:
        raise ValueError("restarts must be at least 1")
    if not inference._filled(sequences).limit(1).count():
        raise ValueError("there are no observations")
    starts: dict[int, Hmm] = {}
    failure: Exception | None = None
    for r in range(restarts):
        try:
            starts[r] = model if r == 0 else kmeans.kmeans_init(sequences, model, seed + r) if model.multivariate else randomized(sequences, model, seed, r)
        except (ValueError, ArithmeticError) as e:
            failure = e
    done: dict[int, training.Training] = {}
    for r, t in training.baum_welch_many(sequences, starts, max_iterations).items() if starts else ():
        if isinstance(t, ValueError):
            failure = t
        else:
            done[r] = t
    totals = inference.total_log_likelihoods(sequences, {r: t.model for r, t in done.items()})
    best: training.Training | None = None
    top = -math.inf
    for r, t in done.items():
        logp = totals[r][1]
        if math.isnan(logp):
            failure = ValueError("a restart ended without a log-likelihood")
        elif best is None or logp > top:
            best, top = training.Training(t.model, (*t.history, logp), t.converged, t.reached_max_iterations), logp
    if best is None:
        raise failure or ValueError("no restart gave a model")
    return best
