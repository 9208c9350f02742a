"""k-means over observation vectors, to start a model's emissions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .emissions import fit_groups
from .model import Hmm


def squared_distance(x: Column, centre: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def nearest(x: Column, centres: list[list[float]]) -> Column:
    """The index of the nearest centre, the lowest of equals."""
    d = F.array(*(squared_distance(x, c) for c in centres))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def seed_centres(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """k-means++: the first point at random, each next one with probability proportional to its squared distance from
    those before. Points are ranked by hashed exponential clocks, so a choice is one aggregate."""
    if k < 1 or points.limit(k).count() < k:
        raise ValueError("there are fewer points than clusters")
    # equal points share a clock, which runs as many times as fast
    distinct = points.groupBy("x").agg(F.count(F.lit(1)).alias("n")).cache()
    centres: list[list[float]] = []
    try:
        for i in range(k):
            uniform = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "x"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
            weight = F.lit(1.0) if not centres else F.array_min(F.array(*(squared_distance(F.col("x"), c) for c in centres)))
            clock = F.when(weight > 0, -F.ln(uniform) / (weight * F.col("n")))
            found = distinct.select("x", clock.alias("c")).agg(F.min_by("x", "c")).first()[0]
            if found is None:  # all points are centres already
                found = distinct.agg(F.min("x")).first()[0]
            centres.append([float(v) for v in found])
    finally:
        distinct.unpersist()
    return centres


def _sums(packed: DataFrame, centres: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(k x D sums, k sizes) of the points nearest to each centre, the lowest of equals, in one job over packed blocks."""
    k, dim = len(centres), len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1))
        for batch in batches:
            for data in blocks.unpacked(batch, True):
                x = data.xs.T
                if len(x) != dim:
                    raise ValueError("the points differ in size from the centres")
                d = np.zeros((k, x.shape[1]))
                for i, c in enumerate(centres):
                    for row, v in zip(x, c, strict=True):
                        gap = row - v
                        gap *= gap
                        d[i] += gap
                near = np.where(np.isnan(d), np.inf, d).argmin(0)
                total[:, dim] += np.bincount(near, minlength=k)
                for j, row in enumerate(x):
                    total[:, j] += np.bincount(near, row, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found = packed.mapInArrow(run, "v binary").collect()  # one row a task
    total = np.sum([np.zeros((k, dim + 1)), *(np.frombuffer(r["v"]).reshape(k, dim + 1) for r in found)], 0)
    return total[:, :dim], total[:, dim]


def lloyd(points: DataFrame, centres: list[list[float]], max_iterations: int = 100) -> list[list[float]]:
    """Centres after Lloyd's iterations; a cluster without points keeps its centre. points(x ARRAY<DOUBLE>)."""
    return _lloyd(blocks.pack(points.select(F.array("x").alias("xs")), multivariate=True, states=len(centres)), centres, max_iterations)


def _lloyd(packed: DataFrame, centres: list[list[float]], max_iterations: int) -> list[list[float]]:
    """Lloyd's iterations over packed points. Blocks are cached and summed in one order: centres that stand still do so
    in all digits, which ends the iterations."""
    packed = packed.cache()
    try:
        for _ in range(max_iterations):
            sums, sizes = _sums(packed, centres)
            new = [[float(v) for v in row / n] if n else list(c) for row, n, c in zip(sums, sizes, centres, strict=True)]
            if np.allclose(new, centres, rtol=0, atol=0):
                break
            centres = new
    finally:
        packed.unpersist()
    return centres


def kmeans_init(sequences: DataFrame, model: Hmm, seed: int = 0, max_iterations: int = 100) -> Hmm:
    """The model with each state's emission fitted to one cluster of all observation vectors, whatever their order;
    a state without points is reset. Initial and transition probabilities stay."""
    points = sequences.select(F.explode("xs").alias("x"))
    points = points if model.multivariate else points.select(F.array("x").alias("x"))
    points = points.cache()
    try:
        packed = blocks.pack(sequences, model.multivariate, model.states)
        centres = _lloyd(packed, seed_centres(points, model.states, seed), max_iterations)
        rows = points.select("x", nearest(F.col("x"), centres).alias("c"))
        sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = rows if model.multivariate else rows.withColumn("x", F.col("x")[0])
        fitted = fit_groups(rows, {i: e for i, e in enumerate(model.emissions) if sizes.get(i)}, "c", "x")
        return model.replace(emissions=tuple(fitted.get(i, e.reset()) for i, e in enumerate(model.emissions)))
    finally:
        points.unpersist()
