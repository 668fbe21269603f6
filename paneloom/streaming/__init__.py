"""Structured Streaming forms of the event features."""
