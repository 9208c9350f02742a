"""Which of two equal plans runs: a Catalyst fold or NumPy over Arrow batches."""

from __future__ import annotations

#: States up to which a fold is the default. Measured on 8 threads in observations a millisecond, fold and NumPy:
#: sequences of 70 steps: 941, 2966 (1 state); 660, 2248 (2); 462, 2443 (4); 238, 1783 (8);
#: sequences of 5,000 steps: 1118, 1004 (1 state); 964, 981 (2); 532, 900 (4); 221, 756 (8).
#: A fold keeps only one step's values, so it remains the choice (fold=True) where a batch of sequences is too large
#: for a worker; score_chunked() is the one for a sequence that no task should hold.
FOLD_STATES = 1


def use_fold(states: int) -> bool:
    return states <= FOLD_STATES
