"""Structured Streaming variants of ingest, episodes, trend and state."""
