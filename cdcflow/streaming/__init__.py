"""Structured Streaming over the batch plan."""
