"""Composed work: one batch, the analytics queries and the registered catalogue."""
