"""Structured Streaming over task events."""
