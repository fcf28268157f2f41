"""The registered queries: a world of archives derived from the given tables."""
