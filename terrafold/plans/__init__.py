"""Plans of the fragment engine."""
