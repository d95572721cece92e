"""Structured Streaming forms of the single-pass operators."""
