"""Operators of the graph-memory engine."""
