"""Operators over run, task, manifest, page and probe tables: DataFrames in, DataFrames out."""
