"""Numeric functions: special functions, log-space helpers, small linear algebra, and the two expression backends."""
