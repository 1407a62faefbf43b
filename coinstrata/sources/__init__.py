"""Readers, writers and projections of ledger tables."""
