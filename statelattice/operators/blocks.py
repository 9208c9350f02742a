"""Sequence tables packed for training: each row is a block of many sequences, which every iteration reads as it is.

A block lists its sequences by falling length and its steps by time, so those that have a step t are the first ones of
step t: the recurrences advance all of them in a few vector operations, without padding and without masks.

Expectations run in probability space, scaled at each step. What a product loses below the smallest double is bounded
by 1e-308 over the smallest scale times the largest backward value; where that isn't negligible (see TINY) or an
observation is impossible, the sequence is left to the recurrences in log space (kernels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import inference, kernels
from .model import Hmm

#: Doubles in a working array of a block (a longer sequence is a block of its own).
WORK = 1 << 18

#: Scales below this, and backward values above its inverse, send a sequence to log space: products of two of them
#: are still far above what is lost.
TINY = 1e-100

#: Tasks for each core that a packed table has at most: every iteration pays for its tasks.
TASKS = 2


@dataclass(frozen=True)
class Block:
    """lengths fall; xs has an observation (T in all, or T x D) for each step, ordered by time."""

    lengths: np.ndarray
    xs: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        """The place of each step's first observation, and the end."""
        counts = len(self.lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.lengths[0]), side="right")
        return np.concatenate([[0], np.cumsum(counts)])

    def sequence(self, i: int) -> np.ndarray:
        return self.xs[self.starts[: self.lengths[i]] + i]

    def owners(self) -> np.ndarray:
        """The sequence of each observation."""
        starts = self.starts
        return np.arange(len(self.xs)) - np.repeat(starts[:-1], np.diff(starts))


def block(sequences: list[np.ndarray]) -> Block:
    """A block of non-empty sequences, of one dimension."""
    lengths = np.array([len(s) for s in sequences], int)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order])
    t = np.arange(len(flat)) - np.repeat(np.cumsum(lengths[order]) - lengths[order], lengths[order])
    return Block(lengths[order], flat[np.argsort(t, kind="stable")])


def pack(sequences: DataFrame, multivariate: bool, states: int) -> DataFrame:
    """The non-empty sequences as rows of blocks, for models of up to `states` states. Cache it where it is read more
    than once."""
    size = max(1, WORK // states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = inference._lists(batch.column(0), multivariate)
            groups: dict[int, list[np.ndarray]] = {}
            for s in sorted(xs, key=len, reverse=True):
                groups.setdefault(s.shape[1] if s.ndim > 1 else 1, []).append(s)
            for dim, group in groups.items():
                at = 0
                while at < len(group):
                    end, steps = at + 1, len(group[at])
                    while end < len(group) and steps + len(group[end]) <= size:
                        steps += len(group[end])
                        end += 1
                    b = block(group[at:end])
                    # vectors are stored component by component
                    values = [b.lengths.astype(np.int64).tobytes(), np.ascontiguousarray(b.xs.T).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["dim", "lengths", "xs"])
                    at = end

    rows = inference._filled(sequences).select("xs").coalesce(TASKS * sequences.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, "dim int, lengths binary, xs binary")


def unpacked(batch: pa.RecordBatch, multivariate: bool) -> Iterator[Block]:
    """The blocks of rows of pack()."""
    for dim, lengths, xs in zip(*(batch.column(i) for i in range(3)), strict=True):
        n, x = np.frombuffer(lengths.as_buffer(), np.int64), np.frombuffer(xs.as_buffer(), float)
        yield Block(n, x.reshape(dim.as_py(), int(n.sum())).T if multivariate else x)


@dataclass(frozen=True)
class Expected:
    """Sums over a block's sequences of finite likelihood; xs and gamma are the observations of these and their
    posteriors, states first."""

    sequences: int
    logp: float
    initial: np.ndarray
    transitions: np.ndarray
    leaving: np.ndarray
    occupancy: np.ndarray
    xs: np.ndarray
    gamma: np.ndarray


def _in_log_space(model: Hmm, sequences: list[np.ndarray]) -> Iterator[Expected]:
    sizes = np.array([len(s) for s in sequences], int)
    for part in kernels.blocks(sizes, model.states):
        own, lengths = [sequences[i] for i in part], sizes[part]
        b = kernels.emissions(model, own)
        a = kernels.forward(model, b, lengths)
        logp = kernels.log_likelihood(a)
        ok = np.isfinite(logp)
        if not ok.any():
            continue
        own, lengths, b, a, logp = [s for s, k in zip(own, ok, strict=True) if k], lengths[ok], b[ok], a[ok], logp[ok]
        beta = kernels.backward(model, b, lengths)
        gamma = kernels.posteriors(a, beta, logp)
        t = np.arange(b.shape[1])[None, :]
        here, leaves = t < lengths[:, None], t < lengths[:, None] - 1
        xi = kernels.transitions(model, a, b, beta, logp, lengths)
        yield Expected(len(own), float(logp.sum()), gamma[:, 0].sum(0), xi, gamma[leaves].sum(0), gamma[here].sum(0), np.concatenate(own), gamma[here].T)


def expected(model: Hmm, data: Block) -> Iterator[Expected]:
    """Expected counts of a block, in one or more parts."""
    starts, n = data.starts, model.states
    first, total, trans = int(starts[1]), len(data.xs), np.array(model.trans)
    cuts = [(int(s), int(e)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    b = np.empty((n, total))
    for i, e in enumerate(model.emissions):
        b[i] = e.logpdf(data.xs)
    top = b.max(0)
    with np.errstate(all="ignore"):
        b -= top
        np.exp(b, out=b)
        a, scale = np.empty_like(b), np.empty(total)
        np.multiply(np.array(model.pi)[:, None], b[:, :first], out=a[:, :first])
        np.add.reduce(a[:, :first], 0, out=scale[:first])
        a[:, :first] /= scale[:first]
        into = np.ascontiguousarray(trans.T)
        for (s, _), (u, v) in zip(cuts, cuts[1:], strict=False):
            now = a[:, u:v]
            np.matmul(into, a[:, s : s + v - u], out=now)
            now *= b[:, u:v]
            np.add.reduce(now, 0, out=scale[u:v])
            now /= scale[u:v]
        beta, ahead = np.ones_like(b), b  # ahead: b x beta / scale, in the place of b
        ahead /= scale
        for (s, _), (u, v) in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            now = ahead[:, u:v]
            now *= beta[:, u:v]
            np.matmul(trans, now, out=beta[:, s : s + v - u])
    odd, xs = np.zeros(len(data.lengths), bool), data.xs
    if not (scale.min() >= TINY and beta.max() <= 1 / TINY and np.isfinite(top).all()):
        owners = data.owners()
        odd[owners[~((scale >= TINY) & (beta.max(0) <= 1 / TINY) & np.isfinite(top))]] = True
        out = odd[owners]
        a[:, out], beta[:, out], ahead[:, out], scale[out], top[out] = 0.0, 0.0, 0.0, 1.0, 0.0
        yield from _in_log_space(model, [data.sequence(i) for i in np.flatnonzero(odd)])
        if odd.all():
            return
    counts = np.zeros((n, n))
    for (s, _), (u, v) in zip(cuts, cuts[1:], strict=False):
        counts += a[:, s : s + v - u] @ ahead[:, u:v].T
    gamma = a
    gamma *= beta
    initial, occupancy = gamma[:, :first].sum(1), gamma.sum(1)
    last = starts[data.lengths - 1] + np.arange(len(data.lengths))
    ends = gamma[:, last]
    gamma[:, last] = 0.0
    leaving = gamma.sum(1)
    gamma[:, last] = ends
    if odd.any():
        xs, kept = xs[~out], gamma[:, ~out]
    else:
        kept = gamma
    yield Expected(int((~odd).sum()), float(np.log(scale).sum() + top.sum()), initial, trans * counts, leaving, occupancy, xs, kept)


@dataclass(frozen=True)
class Assigned:
    """Counts over the best paths of a block's possible sequences; xs and states are the steps of these."""

    sequences: int
    logp: float
    initial: np.ndarray
    moves: np.ndarray
    xs: np.ndarray
    states: np.ndarray


def assigned(model: Hmm, data: Block) -> Assigned:
    """Best paths, ties to the lowest state."""
    starts, n = data.starts, model.states
    cuts = [(int(s), int(e)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    first, step = int(starts[1]), model.log_trans
    b = np.empty((n, len(data.xs)))
    for i, e in enumerate(model.emissions):
        b[i] = e.logpdf(data.xs)
    back = np.zeros(b.shape, np.min_scalar_type(n))
    best = b  # in its place
    best[:, :first] += model.log_pi[:, None]
    for (s, _), (u, v) in zip(cuts, cuts[1:], strict=False):
        before = best[:, s : s + v - u]
        now = before[0] + step[0][:, None]
        for i in range(1, n):
            reach = before[i] + step[i][:, None]
            np.copyto(back[:, u:v], i, where=reach > now)
            np.maximum(now, reach, out=now)
        best[:, u:v] += now
    last = starts[data.lengths - 1] + np.arange(len(data.lengths))
    ends = best[:, last]
    logp, state = ends.max(0), ends.argmax(0)
    states = np.empty(len(data.xs), np.int64)
    for t in range(len(cuts) - 1, -1, -1):
        u, v = cuts[t]
        states[u:v] = state[: v - u]
        if t:
            state[: v - u] = back[state[: v - u], np.arange(u, v)]
    ok, xs = logp > -math.inf, data.xs
    keep = np.ones(len(xs), bool) if ok.all() else ok[data.owners()]
    moves = np.zeros(n * n)
    for (s, _), (u, v) in zip(cuts, cuts[1:], strict=False):
        moves += np.bincount((states[s : s + v - u] * n + states[u:v])[keep[u:v]], minlength=n * n)
    initial = np.bincount(states[:first][keep[:first]], minlength=n)
    if not ok.all():
        xs, states = xs[keep], states[keep]
    return Assigned(int(ok.sum()), float(logp[ok].sum()), initial, moves.reshape(n, n), xs, states)
