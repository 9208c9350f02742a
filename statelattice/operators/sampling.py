"""Ancestral sampling of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .model import Hmm


def _draw(p: np.ndarray, rng: np.random.Generator, n: int = 1) -> np.ndarray:
    total = p.sum()
    if not total > 0:
        raise ValueError("can't draw from probabilities that are all zero")
    return np.minimum(np.searchsorted(np.cumsum(p / total), rng.random(n), side="right"), len(p) - 1)


def sample_local(model: Hmm, length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(states, observations) of one sequence; rows of probabilities needn't be normalised."""
    states = np.zeros(length, int)
    shape = (length, model.dim) if model.multivariate else (length,)
    xs = np.zeros(shape)
    if not length:
        return states, xs
    trans = np.array(model.trans)
    states[0] = _draw(np.array(model.pi), rng)[0]
    for t in range(1, length):
        states[t] = _draw(trans[states[t - 1]], rng)[0]
    for i, emission in enumerate(model.emissions):
        here = states == i
        if here.any():
            xs[here] = emission.sample(rng, int(here.sum()))
    return states, xs


def sample(spark: SparkSession, model: Hmm, sequences: int, length: int, seed: int = 0) -> DataFrame:
    """(seq_id, states, xs): each sequence from its own generator, seeded by (seed, seq_id), whatever the partitions."""
    model.require_initialized()
    x_type, arrow = ("array<array<double>>", pa.list_(pa.list_(pa.float64()))) if model.multivariate else ("array<double>", pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256)
                drawn = [sample_local(model, length, np.random.default_rng([seed, i.as_py()])) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([s.tolist() for s, _ in drawn], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in drawn], arrow)], ["seq_id", "states", "xs"]
                )

    return spark.range(sequences).withColumnRenamed("id", "seq_id").mapInArrow(run, f"seq_id long, states array<int>, xs {x_type}")
