"""Structured Streaming forms of idempotent ingest, chain checks and facets."""
