"""Streaming of the fragment engine."""
