"""The immutable model specification: initial and transition probabilities and one emission for each state."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np

from ..functions.logspace import safe_log
from .emissions import Emission, Gaussian


@dataclass(frozen=True)
class Hmm:
    pi: tuple[float, ...]
    trans: tuple[tuple[float, ...], ...]
    emissions: tuple[Emission, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "pi", tuple(float(p) for p in self.pi))
        object.__setattr__(self, "trans", tuple(tuple(float(p) for p in row) for row in self.trans))
        object.__setattr__(self, "emissions", tuple(self.emissions))
        n = len(self.pi)
        if n < 1:
            raise ValueError("a model needs at least one state")
        if len(self.trans) != n or any(len(row) != n for row in self.trans) or len(self.emissions) != n:
            raise ValueError(f"{n} initial probabilities need an {n} x {n} transition matrix and {n} emissions")
        if len({e.multivariate for e in self.emissions}) > 1 or len({e.dim for e in self.emissions}) > 1:
            raise ValueError("all emissions must be of one dimension")

    @classmethod
    def blank(cls, states: int = 4, emission: Emission | None = None) -> Hmm:
        """Zero probabilities and default emissions: trainers other than segmental k-means reject it."""
        if states < 1:
            raise ValueError("a model needs at least one state")
        return cls((0.0,) * states, ((0.0,) * states,) * states, (emission or Gaussian(),) * states)

    @classmethod
    def uniform(cls, emissions: list[Emission] | tuple[Emission, ...]) -> Hmm:
        n = len(emissions)
        return cls((1 / n,) * n, ((1 / n,) * n,) * n, tuple(emissions))

    @property
    def states(self) -> int:
        return len(self.pi)

    @property
    def multivariate(self) -> bool:
        return self.emissions[0].multivariate

    @property
    def dim(self) -> int:
        return self.emissions[0].dim

    @property
    def log_pi(self) -> np.ndarray:
        return safe_log(np.array(self.pi))

    @property
    def log_trans(self) -> np.ndarray:
        return safe_log(np.array(self.trans))

    def replace(self, **changes: object) -> Hmm:
        return dataclasses.replace(self, **changes)

    def clone(self) -> Hmm:
        return self.replace()

    def require_initialized(self) -> None:
        """Rejects a model whose initial or transition probabilities are all zero; sums are the caller's business."""
        if not any(self.pi) or not any(map(any, self.trans)):
            raise ValueError("the model's initial or transition probabilities are all zero")

    def validate(self, tolerance: float = 1e-6) -> None:
        """Rejects what isn't stochastic."""
        self.require_initialized()
        rows = [("initial probabilities", self.pi), *((f"transitions from state {i}", row) for i, row in enumerate(self.trans))]
        for name, row in rows:
            if any(not 0 <= p <= 1 for p in row) or abs(sum(row) - 1) > tolerance:
                raise ValueError(f"{name} aren't a distribution: {row}")
