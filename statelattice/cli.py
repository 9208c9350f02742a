"""Command line: checks model files and scores observations.

    python -m statelattice.cli MODEL.json [x ...]
"""

from __future__ import annotations

import sys

import numpy as np

from .operators import kernels
from .operators.model import Hmm
from .sources import model_json, model_text


def load(path: str) -> Hmm:
    """A model in JSON or, by its suffix, XML."""
    return model_text.load_xml(path) if path.endswith(".xml") else model_json.load(path)


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    try:
        model = load(args[0])
        model.validate(1e-4)
    except (OSError, ValueError) as e:
        print(f"invalid: {e}")
        return 1
    print(f"valid: {model.states} states, {', '.join(e.tag for e in model.emissions)}")
    if args[1:] and not model.multivariate:
        xs = np.array([float(a) for a in args[1:]])
        lengths = np.array([len(xs)])
        b = kernels.emissions(model, [xs])
        logp = kernels.log_likelihood(kernels.forward(model, b, lengths))[0]
        best, path = kernels.viterbi(model, b, lengths)
        print(f"log-likelihood {logp:.6f}; best path {' '.join(map(str, path[0]))} ({best[0]:.6f})")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
