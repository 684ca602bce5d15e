"""Whole tasks composed of sources, operators and sinks, and the queries that exercise them."""
