"""Sources of the graph-memory engine."""
