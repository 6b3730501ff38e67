"""Operators on DataFrames: version resolution, traversal, compaction, indexes."""
