"""Sequence analytics on Spark: hidden Markov models over ordered tables."""
