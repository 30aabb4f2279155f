"""plans of the alignment analytics engine."""
