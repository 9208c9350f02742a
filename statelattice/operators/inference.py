"""Scoring and decoding of sequence tables (seq_id, xs).

Scores come from NumPy over Arrow batches, many sequences at a time, or from a fold in Catalyst: no Python worker
starts, and only the present step's values are kept, however long a sequence is. See plans.policy for the choice.
Everything that needs whole lattices (backward values, posteriors, paths) runs in NumPy.

Empty and NULL sequences have no result rows. NULL inside a sequence counts as NaN, which no emission supports.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logspace import let, log_sum_column
from ..plans.policy import use_fold
from . import kernels
from .model import Hmm


def _filled(sequences: DataFrame) -> DataFrame:
    return sequences.where(F.size("xs") > 0)


# -- folds -----------------------------------------------------------------------------------------------------


def _emitted(model: Hmm, x: Column) -> Column:
    return F.array(*(e.column(x) for e in model.emissions))


def _constants(values: np.ndarray) -> Column:
    return F.array(*(_constants(v) if np.ndim(v) else F.lit(float(v)) for v in values))


def _fold(model: Hmm, xs: Column, join: Callable[[Column], Column]) -> Column:
    """The forward recurrence with `join` over predecessors (log-sum-exp or maximum), joined at the end."""
    into = _constants(model.log_trans.T)
    x0 = F.element_at(xs, 1)
    start = F.zip_with(_constants(model.log_pi), _emitted(model, x0), lambda p, b: p + b)

    def step(a: Column, x: Column) -> Column:
        reached = F.transform(into, lambda row: join(F.zip_with(a, row, lambda p, q: p + q)))
        return F.zip_with(reached, _emitted(model, x), lambda r, b: r + b)

    rest = F.slice(xs, F.lit(2), F.size(xs) - 1)
    return F.aggregate(rest, start, step, join)


def _scored(model: Hmm, sequences: DataFrame, join: Callable[[Column], Column]) -> DataFrame:
    rows = _filled(sequences)
    return rows.select("seq_id", F.size("xs").alias("n"), let(F.col("xs"), lambda xs: _fold(model, xs, join)).alias("logp"))


# -- Arrow -----------------------------------------------------------------------------------------------------


def _lists(column: pa.Array, multivariate: bool) -> list[np.ndarray]:
    """The sequences of an Arrow list column, T or T x D each."""
    if multivariate:
        vectors = column.flatten()
        sizes = vectors.value_lengths()
        if len(vectors) and not vectors.null_count and sizes[0].as_py() and pc.min_max(sizes)["min"] == pc.min_max(sizes)["max"]:
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
            return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1])
        out = []
        for s in column:
            rows = [[math.nan if v is None else v for v in (r or [])] for r in s.as_py()]
            if len({len(r) for r in rows}) > 1:
                raise ValueError("the vectors of a sequence differ in dimension")
            out.append(np.array(rows, float))
        return out
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def over_batches(sequences: DataFrame, model: Hmm, schema: str, work: Callable[[list[Any], list[np.ndarray], np.ndarray], pa.RecordBatch]) -> DataFrame:
    """work(ids, sequences, lengths) for blocks of non-empty sequences of similar length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = batch.column(0), _lists(batch.column(1), model.multivariate)
            lengths = np.array([len(s) for s in xs], int)
            for part in kernels.blocks(lengths, model.states):
                yield work(ids.take(pa.array(part)), [xs[i] for i in part], lengths[part])

    return _filled(sequences).select("seq_id", "xs").mapInArrow(run, schema)


def _id_type(sequences: DataFrame) -> str:
    return dict(sequences.dtypes)["seq_id"]


def score(sequences: DataFrame, model: Hmm, fold: bool | None = None) -> DataFrame:
    """(seq_id, n, logp): log-likelihood of each sequence, minus infinity where the model can't produce it."""
    model.require_initialized()
    if use_fold(model.states) if fold is None else fold:
        return _scored(model, sequences, log_sum_column)

    def work(ids: Any, xs: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
        logp = kernels.log_likelihood(kernels.forward(model, kernels.emissions(model, xs), lengths))
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), pa.array(logp, pa.float64())], ["seq_id", "n", "logp"])

    return over_batches(sequences, model, f"seq_id {_id_type(sequences)}, n int, logp double", work)


def score_chunked(steps: DataFrame, model: Hmm, chunk: int = 4096) -> DataFrame:
    """(seq_id, n, logp) of steps(seq_id, t, x), t dense from 0: scores without gathering a sequence.

    Each run of `chunk` steps becomes one N x N matrix of log-sums over its inner paths; matrices multiply in log
    space, so a sequence's likelihood is the product of its few matrices. A sequence that holds most of the table is
    spread over as many tasks as it has chunks. NULL observations make a sequence impossible.
    """
    model.require_initialized()
    n, log_a, log_pi = model.states, model.log_trans, model.log_pi
    grouped = steps.withColumn("c", F.floor(F.col("t") / chunk).cast("long")).groupBy("seq_id", "c").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    parts = grouped.select("seq_id", "c", F.transform("s", lambda s: s["x"]).alias("xs"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, out = _lists(batch.column(2), model.multivariate), []
            for c, x in zip(batch.column(1).to_pylist(), xs, strict=True):
                b = np.stack([e.logpdf(x) for e in model.emissions], 1)
                # row i: from state i just before the chunk (the first chunk starts from pi instead)
                m = np.broadcast_to(log_pi, (n, n)) + b[0] if c == 0 else log_a + b[0]
                for row in b[1:]:
                    m = kernels.log_product(m, log_a) + row
                out.append(m.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in xs], pa.int64()), pa.array([m.tolist() for m in out], pa.list_(pa.float64()))], ["seq_id", "c", "n", "m"]
            )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logp = []
            for s in batch.column(2).to_pylist():
                m = np.array(s[0]["m"]).reshape(n, n)[:1]
                for other in s[1:]:
                    m = kernels.log_product(m, np.array(other["m"]).reshape(n, n))
                logp.append(float(kernels.log_sum(m[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logp, pa.float64())], ["seq_id", "n", "logp"])

    kind = _id_type(steps)
    made = parts.mapInArrow(matrices, f"seq_id {kind}, c long, n long, m array<double>")
    joined = made.groupBy("seq_id").agg(F.sum("n").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("c", "m"))).alias("s"))  # N * N doubles a chunk
    return joined.mapInArrow(products, f"seq_id {kind}, n int, logp double")


def viterbi_score(sequences: DataFrame, model: Hmm, fold: bool | None = None) -> DataFrame:
    """(seq_id, n, logp): log-probability of each sequence's best path."""
    model.require_initialized()
    if use_fold(model.states) if fold is None else fold:
        return _scored(model, sequences, F.array_max)
    return viterbi(sequences, model).select("seq_id", F.size("path").alias("n"), "logp")


def viterbi(sequences: DataFrame, model: Hmm) -> DataFrame:
    """(seq_id, logp, path): the best path of each sequence, ties to the lowest state."""
    model.require_initialized()

    def work(ids: Any, xs: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
        logp, paths = kernels.viterbi(model, kernels.emissions(model, xs), lengths)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(logp, pa.float64()), pa.array([p[:n] for p, n in zip(paths, lengths, strict=True)], pa.list_(pa.int32()))], ["seq_id", "logp", "path"]
        )

    return over_batches(sequences, model, f"seq_id {_id_type(sequences)}, logp double, path array<int>", work)


def posterior_decode(sequences: DataFrame, model: Hmm, impossible: str = "raise") -> DataFrame:
    """(seq_id, logp, path): the likeliest state at each step, ties to the lowest. A sequence that the model can't
    produce raises, or has a NULL path with impossible="null"."""
    model.require_initialized()

    def work(ids: Any, xs: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
        b = kernels.emissions(model, xs)
        a = kernels.forward(model, b, lengths)
        logp = kernels.log_likelihood(a)
        if impossible == "raise" and np.isneginf(logp).any():
            raise ValueError(f"sequence {ids[int(np.isneginf(logp).argmax())]} has probability 0")
        with np.errstate(invalid="ignore"):
            best = (a + kernels.backward(model, b, lengths)).argmax(2)
        paths = [None if np.isneginf(p) else row[:n].astype(np.int32) for p, row, n in zip(logp, best, lengths, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(logp, pa.float64()), pa.array(paths, pa.list_(pa.int32()))], ["seq_id", "logp", "path"])

    return over_batches(sequences, model, f"seq_id {_id_type(sequences)}, logp double, path array<int>", work)


def lattice(sequences: DataFrame, model: Hmm, kind: str) -> DataFrame:
    """(seq_id, t, state, value): every value of one kind: "forward", "backward", "emission" (all logarithms) or
    "posterior" (probabilities; a sequence of probability 0 has none)."""
    model.require_initialized()
    n = model.states

    def work(ids: Any, xs: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
        b = kernels.emissions(model, xs)
        if kind == "emission":
            values = b
        elif kind == "backward":
            values = kernels.backward(model, b, lengths)
        else:
            values = kernels.forward(model, b, lengths)
        if kind == "posterior":
            logp = kernels.log_likelihood(values)
            values = kernels.posteriors(values, kernels.backward(model, b, lengths), logp)
            lengths = np.where(np.isneginf(logp), 0, lengths)
        here = np.arange(values.shape[1])[None, :] < lengths[:, None]
        which, t = np.nonzero(here)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(np.repeat(which, n))),
                pa.array(np.repeat(t, n), pa.int32()),
                pa.array(np.tile(np.arange(n), len(t)), pa.int32()),
                pa.array(values[here].reshape(-1), pa.float64()),
            ],
            ["seq_id", "t", "state", "value"],
        )

    if kind not in ("forward", "backward", "emission", "posterior"):
        raise ValueError(f"unknown kind {kind!r}")
    return over_batches(sequences, model, f"seq_id {_id_type(sequences)}, t int, state int, value double", work)


def steps(paths: DataFrame) -> DataFrame:
    """(seq_id, t, state) of a table of paths."""
    return paths.select("seq_id", F.posexplode("path").alias("t", "state"))


def total_log_likelihood(scores: DataFrame) -> DataFrame:
    """One row: n_sequences, n_observations, logp."""
    return scores.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").cast("long").alias("n_observations"), F.coalesce(F.sum("logp"), F.lit(0.0)).alias("logp"))


def total_log_likelihoods(sequences: DataFrame, models: dict[Any, Hmm]) -> dict[Any, tuple[int, float]]:
    """(observations, log-likelihood) of all sequences under each model, in one pass over them."""
    if not models:
        return {}
    listed = list(models.items())
    for _, model in listed:
        model.require_initialized()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, logp = 0, np.zeros(len(listed))
        for batch in batches:
            xs = _lists(batch.column(0), listed[0][1].multivariate)
            lengths = np.array([len(s) for s in xs], int)
            n += int(lengths.sum())
            for i, (_, model) in enumerate(listed):
                for part in kernels.blocks(lengths, model.states):
                    own = [xs[j] for j in part]
                    logp[i] += kernels.log_likelihood(kernels.forward(model, kernels.emissions(model, own), lengths[part])).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(listed)), pa.int32()), pa.array([n] * len(listed), pa.int64()), pa.array(logp, pa.float64())], ["i", "n", "logp"])

    found = _filled(sequences).select("xs").mapInArrow(run, "i int, n long, logp double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("logp").alias("logp")).collect()  # one row a model
    by = {r["i"]: r for r in found}
    return {name: (by[i]["n"], by[i]["logp"]) if by else (0, 0.0) for i, (name, _) in enumerate(listed)}


# -- anomaly scores --------------------------------------------------------------------------------------------

#: The score of an impossible sequence, and the thresholds in standard deviations.
IMPOSSIBLE = -1e9
THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0)


def normalized(scores: DataFrame) -> DataFrame:
    """scores with `score`: log-likelihood per observation, IMPOSSIBLE where that isn't finite."""
    ok = ~F.isnan("logp") & (F.abs("logp") < F.lit(math.inf))
    return scores.withColumn("score", F.when(ok, F.col("logp") / F.col("n")).otherwise(F.lit(IMPOSSIBLE)))


def detection_table(scored: DataFrame, label: str) -> DataFrame:
    """(k, threshold, tp, fp, n_positive, n_negative, tpr, fpr): flags below mean - k sd of the unlabelled scores."""
    base = scored.where(~F.col(label)).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    bad = F.col(label)
    out = scored.withColumn("k", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    flagged = F.col("score") < F.lit(base["m"]) - F.col("k") * F.lit(base["s"])
    counted = out.groupBy("k").agg(
        F.sum((flagged & bad).cast("long")).alias("tp"), F.sum((flagged & ~bad).cast("long")).alias("fp"),
        F.sum(bad.cast("long")).alias("n_positive"), F.sum((~bad).cast("long")).alias("n_negative"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumn("threshold", F.lit(base["m"]) - F.col("k") * F.lit(base["s"])).withColumn("tpr", rate("tp", "n_positive")).withColumn("fpr", rate("fp", "n_negative"))


def effect_size(scored: DataFrame, label: str) -> float:
    """Cohen's d between unlabelled and labelled scores, with the root mean of both variances."""
    r = {x[label]: x for x in scored.groupBy(label).agg(F.avg("score").alias("m"), F.var_pop("score").alias("v")).collect()}  # two rows
    if len(r) < 2:
        return math.nan
    spread = math.sqrt((r[True]["v"] + r[False]["v"]) / 2)
    return (r[False]["m"] - r[True]["m"]) / spread if spread else math.nan


