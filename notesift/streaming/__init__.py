"""Structured Streaming forms of the stateless plans."""
