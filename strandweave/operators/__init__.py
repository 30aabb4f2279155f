"""operators of the alignment analytics engine."""
