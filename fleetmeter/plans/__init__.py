"""Runnable jobs: the operators wired to the given tables, each with an equivalent SQL query."""
