"""Spark-native long-read sequence alignment analytics."""
