"""Operators over DataFrames: metrics, ordered sequences, selection, sets and similarity, graphs, dialogue records."""
