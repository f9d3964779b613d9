"""Operators for large-scale training data: one module per operator, queries in ``queries``."""
