"""Operators on DataFrames: intervals, graphs, rewriting, sketches, read groups."""
