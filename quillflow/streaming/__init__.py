"""Structured Streaming forms of the work queue."""
