"""Plans of the graph-memory engine."""
