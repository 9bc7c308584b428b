"""Incrementally maintained sketches, in batch and in Structured Streaming."""
