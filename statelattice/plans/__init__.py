"""Choices of physical plan, and the catalogue of registered queries."""
