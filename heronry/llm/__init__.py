"""Operators that prepare training data: one module each, and their queries in queries.py."""
