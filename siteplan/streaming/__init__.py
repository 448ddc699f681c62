"""Structured Streaming jobs over append-only run journals."""
