"""sources of the alignment analytics engine."""
