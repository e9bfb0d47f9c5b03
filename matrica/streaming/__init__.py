"""Incremental runs of batch operators with Structured Streaming (see matrica.streaming.increments)."""
