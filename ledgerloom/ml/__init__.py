"""Ml of the ledger engine."""
