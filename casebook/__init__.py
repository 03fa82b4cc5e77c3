"""Fixture ledgers, the registered queries and their SQL counterparts."""
