"""Operators that prepare training data, and the queries that apply them to the shared tables."""
