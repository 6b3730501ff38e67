"""Queries as data, and their translation to DataFrames."""
