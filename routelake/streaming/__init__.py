"""Structured Streaming wrappers over the operators."""
