"""Structured Streaming twins of the change operators."""
