"""Operators: sample kernels and their relational forms, ranking, gates, timelines."""
