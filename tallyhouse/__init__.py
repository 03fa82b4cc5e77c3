"""Ledger analytics written as Spark DataFrame transformations."""

from tallyhouse.policy import Policy, spanish_policy

__all__ = ["Policy", "spanish_policy"]
