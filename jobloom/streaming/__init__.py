"""Structured Streaming: deduplication, late data, source state."""
