"""Readers of exports and reference tables, and the table writers."""
