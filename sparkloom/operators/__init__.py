"""Relational, task-graph and run operators: DataFrames in, DataFrames out."""
