"""Relational, graph and data-quality operators on DataFrames."""
