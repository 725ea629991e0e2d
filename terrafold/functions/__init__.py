"""Functions of the fragment engine."""
