"""Questions composed of several operators."""
