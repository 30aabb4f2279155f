"""Training-data operators: deduplication, filtering, scanning, packing.

Nothing else in the library imports this subpackage.
"""
