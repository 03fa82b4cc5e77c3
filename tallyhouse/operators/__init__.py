"""Operators on ledgers. Each takes DataFrames and returns a lazy DataFrame."""
