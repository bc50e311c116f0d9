"""Relational operators of the feed engine; each takes and returns DataFrames."""
