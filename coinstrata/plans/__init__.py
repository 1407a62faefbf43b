"""Public queries."""
