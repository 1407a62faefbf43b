"""Relational building blocks of the ledger."""
