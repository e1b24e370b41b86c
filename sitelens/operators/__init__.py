"""Operators over DataFrames: the row filter, rankings, questions, merges and comparisons."""
