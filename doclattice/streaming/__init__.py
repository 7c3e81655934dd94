"""Continuous insertion."""
