"""Predicates and ranges as Column expressions."""
