"""Operators of the fragment engine."""
