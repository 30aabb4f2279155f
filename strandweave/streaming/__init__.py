"""streaming of the alignment analytics engine."""
