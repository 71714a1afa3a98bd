"""Readers for files and the table bindings used by the registered queries."""
