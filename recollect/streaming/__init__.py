"""Streaming of the graph-memory engine."""
