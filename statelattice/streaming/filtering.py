"""The forward recurrence over a stream of observations, one state vector for each key.

An extension: a batch score needs whole sequences, but the filtered state after each observation only needs the one
before. State is N doubles, a log-likelihood and a count a key: it grows with the keys, not with the stream, and with
a timeout only with the keys that aren't silent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.logspace import log_sum
from ..operators.model import Hmm

OUTPUT = "seq_id long, ts timestamp, x double, n long, logp double, state int, probability double"


def filter_stream(stream: DataFrame, model: Hmm, timeout_ms: int | None = None) -> DataFrame:
    """(seq_id, ts, x, n, logp, state, probability) of stream(seq_id long, ts, x): for each observation the running
    log-likelihood, the likeliest present state (ties to the lowest) and its filtered probability.

    Within a micro-batch a key's rows are taken in order of ts; rows that arrive in a later batch come after it. An
    impossible observation leaves the state as it was, with logp minus infinity from there on. With timeout_ms, a key
    that is silent for so much processing time starts anew.
    """
    model.require_initialized()
    if model.multivariate:
        raise ValueError("streams carry scalar observations")

    def advance(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, *held = state.get if state.exists else (0, 0.0, *([0.0] * model.states))
        belief = np.array(held)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        into = model.log_trans.T
        logs = np.stack([e.logpdf(rows["x"].to_numpy(float)) for e in model.emissions], 1)
        out = []
        for ts, x, b in zip(rows["ts"], rows["x"], logs, strict=True):
            joint = (log_sum(belief[None, :] + into) if n else model.log_pi) + b
            step = float(log_sum(joint))
            n, total = n + 1, total + step
            if math.isfinite(step):
                belief = joint - step
            at = int(belief.argmax())
            out.append((key[0], ts, x, n, total, at, math.exp(belief[at])))
        state.update((n, total, *belief.tolist()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["seq_id", "ts", "x", "n", "logp", "state", "probability"])

    fields = ", ".join(["n long", "logp double", *(f"b{i} double" for i in range(model.states))])
    return stream.groupBy("seq_id").applyInPandasWithState(advance, OUTPUT, fields, "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")
