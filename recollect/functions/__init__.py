"""Functions of the graph-memory engine."""
