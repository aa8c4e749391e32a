"""Operators for large-scale training data: one module per operator, their queries in ``queries.py``."""
