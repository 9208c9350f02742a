"""Structural constraints on transitions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

import numpy as np

from ..functions.special import ZERO
from .model import Hmm

Kind = Literal["ergodic", "left_to_right", "left_to_right_skip", "banded"]


@dataclass(frozen=True)
class Topology:
    """ergodic: all moves; left_to_right: j >= i; left_to_right_skip: i <= j <= i + skip; banded: |i - j| <= skip."""

    kind: Kind = "ergodic"
    skip: int = 1

    def __post_init__(self) -> None:
        if self.kind not in ("ergodic", "left_to_right", "left_to_right_skip", "banded"):
            raise ValueError(f"unknown topology {self.kind!r}")
        if self.kind in ("left_to_right_skip", "banded") and self.skip < 1:
            raise ValueError("skip must be at least 1")

    def mask(self, states: int) -> np.ndarray:
        gap = np.arange(states)[None, :] - np.arange(states)[:, None]
        return {
            "ergodic": np.ones_like(gap, bool),
            "left_to_right": gap >= 0,
            "left_to_right_skip": (gap >= 0) & (gap <= self.skip),
            "banded": np.abs(gap) <= self.skip,
        }[self.kind]


def initialize(model: Hmm, topology: Topology) -> Hmm:
    """Transitions uniform over what the topology allows; initial probabilities stay."""
    allowed = topology.mask(model.states).astype(float)
    return model.replace(trans=tuple(map(tuple, allowed / allowed.sum(1, keepdims=True))))


def enforce(model: Hmm, topology: Topology) -> Hmm:
    """Forbidden transitions set to zero and rows scaled up; a row without allowed mass becomes uniform over it."""
    if topology.kind == "ergodic":
        return model
    allowed = topology.mask(model.states)
    trans = np.where(allowed, np.array(model.trans), 0.0)
    mass = trans.sum(1, keepdims=True)
    even = allowed / allowed.sum(1, keepdims=True)
    return model.replace(trans=tuple(map(tuple, np.where(mass < ZERO, even, trans / np.where(mass < ZERO, 1, mass)))))
