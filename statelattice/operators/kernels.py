"""NumPy recurrences over batches of sequences, padded and in log space. They run inside Arrow batches.

A batch of B sequences advances together, so a step of the recurrence is one vector operation over B x N x N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.logspace import log_sum
from .model import Hmm

#: Largest number of doubles in a step's working array.
WORK = 1 << 21


def blocks(lengths: np.ndarray, states: int) -> Iterator[np.ndarray]:
    """Positions of sequences in groups of similar length whose padded arrays stay within WORK."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * max(1, lengths[order[end]]) * states <= WORK and (end - at) * states * states <= WORK:
            end += 1
        yield order[at:end]
        at = end


def emissions(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """B x T x N log-densities; padding is 0."""
    longest = max(len(s) for s in sequences)
    out = np.zeros((len(sequences), longest, model.states))
    flat = np.concatenate(sequences)
    where = np.arange(longest)[None, :] < np.array([len(s) for s in sequences])[:, None]
    out[where] = np.stack([e.logpdf(flat) for e in model.emissions], 1)
    return out


def forward(model: Hmm, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """B x T x N; past a sequence's end its last row is carried on."""
    a = np.empty_like(b)
    a[:, 0] = model.log_pi + b[:, 0]
    step = model.log_trans.T[None]
    for t in range(1, b.shape[1]):
        now = log_sum(a[:, t - 1, None, :] + step) + b[:, t]
        a[:, t] = np.where((t < lengths)[:, None], now, a[:, t - 1])
    return a


def backward(model: Hmm, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros_like(b)
    step = model.log_trans[None]
    for t in range(b.shape[1] - 2, -1, -1):
        now = log_sum(step + (b[:, t + 1] + out[:, t + 1])[:, None, :])
        out[:, t] = np.where((t + 1 < lengths)[:, None], now, 0.0)
    return out


def viterbi(model: Hmm, b: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability, B x T path); ties go to the lowest state."""
    n, longest, _ = b.shape
    best = model.log_pi + b[:, 0]
    back = np.zeros(b.shape, np.int32)
    step = model.log_trans.T[None]
    for t in range(1, longest):
        reach = best[:, None, :] + step
        back[:, t] = reach.argmax(2)
        now = reach.max(2) + b[:, t]
        best = np.where((t < lengths)[:, None], now, best)
    path = np.zeros((n, longest), np.int32)
    rows = np.arange(n)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        path[:, t] = state
        here = (t < lengths) & (t > 0)
        state = np.where(here, back[rows, t, state], state)
    return best.max(1), path


def log_likelihood(a: np.ndarray) -> np.ndarray:
    return log_sum(a[:, -1])


def transitions(model: Hmm, a: np.ndarray, b: np.ndarray, beta: np.ndarray, logp: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected transition counts, N x N, summed over the batch."""
    n, longest, states = b.shape
    total = np.zeros((states, states))
    if longest < 2:
        return total
    step = model.log_trans[None]
    for t in range(longest - 1):
        with np.errstate(invalid="ignore"):
            each = np.exp(a[:, t, :, None] + step + (b[:, t + 1] + beta[:, t + 1])[:, None, :] - logp[:, None, None])
        total += np.where((t + 1 < lengths)[:, None, None], each, 0.0).sum(0)
    return total


def posteriors(a: np.ndarray, beta: np.ndarray, logp: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.exp(a + beta - logp[:, None, None])


def log_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in log space."""
    return log_sum(a[:, :, None] + b[None], axis=1)
