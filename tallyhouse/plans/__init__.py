"""Incremental loads and the refresh of all tables."""
