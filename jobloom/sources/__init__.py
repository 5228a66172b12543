"""Recorded feed payloads to posting rows."""
