"""Registered queries: an operator bound to tables, with its SQL counterpart."""

from importlib import import_module

MODULES = "retrieval evaluation ingest text syllabus schedule practice grades lifecycle streams".split()


def load():
    """Import every plan module; returns the queries and the SQL counterparts."""
    from lectern.plans.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"lectern.plans.{module}")
    return QUERIES, ORACLES
