"""Sources of the fragment engine."""
