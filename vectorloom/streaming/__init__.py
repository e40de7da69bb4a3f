"""Structured Streaming versions of ingest and of the keyed store."""
