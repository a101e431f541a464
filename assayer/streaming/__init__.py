"""Structured Streaming forms of the run-log operators."""
