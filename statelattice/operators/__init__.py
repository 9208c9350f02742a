"""Operators: emission families, inference, training, selection and sampling of hidden Markov models."""
