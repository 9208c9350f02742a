"""Sequence tables from event tables and files; model files."""
