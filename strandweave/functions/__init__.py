"""functions of the alignment analytics engine."""
