"""Composed plans: fixtures built from the given tables, the training /
evaluation / prediction flows, and the query registry."""
